"""Truth maintenance over claim histories: spans, states, as-of reads, existence, conflicts, relations.

A slot is (subject, predicate). Everything here is windows partitioned by slot, so a plan has one shuffle on the slot, which
later steps reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L

SLOT = ("subject", "predicate")
ORDER = ("observed_at", "event_id")


def holds_at(at: Column | None, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Half-open validity; at None asks whether the window is open."""
    if at is None:
        return F.col(valid_to).isNull()
    return (F.col(valid_from).isNull() | (F.col(valid_from) <= at)) & (F.col(valid_to).isNull() | (at < F.col(valid_to)))


def spans(claims: DataFrame, keep_disputed_predecessor: bool = False) -> DataFrame:
    """claims: subject, predicate, bucket, kind, observed_at, event_id. The spans of each slot.

    An assertion or repetition of a value already claimed confirms the latest span of that value; other rows open a span. A
    correction retracts the span before it and takes over its start; a run of corrections goes back to the span before the
    run. Disputed spans (kind conflict) neither close nor are corrected, unless keep_disputed_predecessor. Each live span ends where
    the next one starts; a retracted one's window is empty.
    """
    by_value = Window.partitionBy(*SLOT, "bucket").orderBy(*ORDER)
    opened = claims.withColumn("opens", (F.row_number().over(by_value) == 1) | ~F.col("kind").isin("assert", "repeat"))
    island = opened.withColumn("island", F.sum(F.col("opens").cast("int")).over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
    counted = island.withColumn("confirmations", F.count("*").over(Window.partitionBy(*SLOT, "bucket", "island")) - 1).where("opens").drop("opens", "island")
    disputed = counted.withColumn("disputed", F.col("kind") == "conflict")
    line = Window.partitionBy(*SLOT, F.lit(False) if keep_disputed_predecessor else F.col("disputed")).orderBy(*ORDER)
    base = F.when((F.col("kind") != "correct") | (F.row_number().over(line) == 1), F.col("observed_at"))
    dated = disputed.withColumn("base", base).withColumn("valid_from", F.when(F.col("disputed"), F.col("observed_at")).otherwise(F.last("base", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))))
    marked = dated.withColumn("retracted", F.coalesce(F.lead("kind").over(line) == "correct", F.lit(False)) & (F.lit(keep_disputed_predecessor) | ~F.col("disputed"))).drop("base")
    closer = ~F.col("disputed") & ~F.col("retracted")
    following = F.lead("valid_from").over(Window.partitionBy(*SLOT, closer).orderBy(*ORDER))
    ended = marked.withColumn("valid_to", F.when(F.col("retracted"), F.col("valid_from")).when(closer, following))
    status = F.when(F.col("disputed"), "disputed").when(F.col("retracted"), "corrected").when(F.col("valid_to").isNotNull(), "superseded").otherwise("open")
    return ended.withColumn("status", status)


def state_at(history: DataFrame, at: Column | None) -> DataFrame:
    """KNOWN, UNKNOWN or CONFLICT of each slot: disputed spans compete but never hold, and two values at once conflict."""
    holds = ~F.col("disputed") & ~F.col("retracted") & holds_at(at)
    seen = F.lit(True) if at is None else F.col("observed_at") <= at
    competes = F.col("disputed") & seen
    out = history.groupBy(*SLOT).agg(F.count_if(holds).alias("holding"), F.count_if(competes).alias("competing"), F.count_distinct(F.when(holds, F.col("bucket"))).alias("values"), F.max(F.when(holds, F.struct(*ORDER, "bucket")))["bucket"].alias("value"))
    state = F.when((F.col("holding") > 1), "CONFLICT").when(F.col("holding") == 1, "KNOWN").when(F.col("competing") > 0, "CONFLICT").otherwise("UNKNOWN")
    return out.select(*SLOT, state.alias("state"), F.when(state == "KNOWN", F.col("value")).alias("value"), "holding", "competing")


def as_of(history: DataFrame, questions: DataFrame, belief: bool = False) -> DataFrame:
    """questions: subject, predicate, asked_at, question_id. The span that answers each, an equi-join on the slot with the interval as residual.

    World: of the spans that hold at the time the latest; else the latest that started by then. Belief: the latest observed by then,
    retracted or not, since belief didn't know better yet.
    """
    joined = questions.join(history, list(SLOT), "left")
    if belief:
        ok, rank = F.col("observed_at") <= F.col("asked_at"), F.struct("observed_at", "event_id")
    else:
        started = ~F.col("retracted") & (F.col("valid_from") <= F.col("asked_at"))
        holds = started & (F.col("valid_to").isNull() | (F.col("asked_at") < F.col("valid_to")))
        ok, rank = started, F.struct(holds.alias("h"), F.col("observed_at"), F.col("event_id"))
    best = joined.groupBy("question_id", *SLOT, "asked_at").agg(F.max_by(F.struct("event_id", "bucket"), F.when(ok, rank)).alias("s"))
    return best.select("question_id", *SLOT, "asked_at", F.col("s.event_id").alias("event_id"), F.col("s.bucket").alias("bucket"))


def around_anchor(history: DataFrame, bucket: int) -> DataFrame:
    """The spans before and after the first span of each slot that has the value."""
    w = Window.partitionBy(*SLOT).orderBy(*ORDER)
    usable = history.where(~F.col("retracted")).select(*SLOT, *ORDER, "bucket", F.lag("bucket").over(w).alias("before"), F.lead("bucket").over(w).alias("after"))
    first = usable.where(F.col("bucket") == bucket).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return first.select(*SLOT, "event_id", "before", "after")


def ever(history: DataFrame, bucket: int, known_by: Column | None = None) -> DataFrame:
    """yes or no of each slot: was the value ever true? Superseded counts, corrected and rumoured doesn't."""
    known = F.lit(True) if known_by is None else F.col("observed_at") <= known_by
    hit = (F.col("bucket") == bucket) & ~F.col("disputed") & ~F.col("retracted") & known
    return history.groupBy(*SLOT).agg(F.bool_or(hit).alias("was"), F.count_if(F.col("bucket") == bucket).alias("mentions")).select(*SLOT, F.when(F.col("was"), "yes").otherwise("no").alias("verdict"), "mentions")


def semantics() -> Column:
    """Map from predicate to (cardinality, behaviour, volatility)."""
    return F.create_map(*[x for p, s in L.SEMANTICS.items() for x in (F.lit(p), F.array(*[F.lit(v) for v in s]))])


def relation(held_value: Column, new_value: Column, kind: Column, cardinality: Column, behaviour: Column, volatility: Column, held_at: Column, new_at: Column) -> tuple[Column, Column, Column]:
    """(relation, rule, confidence) of a new statement to a held one; the first rule that applies decides."""
    steps = [
        (held_value == new_value, "REPEAT", "same_value"),
        (kind == "correct", "CORRECT", "explicit_correction"),
        (kind == "conflict", "CONFLICT", "alternative_source"),
        (cardinality.isNull(), "UNKNOWN", "undeclared_predicate"),
        (behaviour == "immutable", "CONFLICT", "immutable_disagreement"),
        (cardinality == "many", "COEXIST", "coexistence_allowed"),
        (held_at.isNull() | new_at.isNull(), "UNKNOWN", "no_observation_times"),
        (new_at <= held_at, "CONFLICT", "not_later"),
        (kind == "supersede", "SUPERSEDE", "revisable_single_valued"),
    ]
    rel = rule = None
    for when, a, b in steps:
        rel = F.when(when, a) if rel is None else rel.when(when, a)
        rule = F.when(when, b) if rule is None else rule.when(when, b)
    rel, rule = rel.otherwise("UNKNOWN"), rule.otherwise("unmarked_value_change")
    table = F.create_map(*[x for k, v in L.RELATION_CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    extra = F.when(rule == "revisable_single_valued", F.when(volatility == "volatile", 0.15).when(volatility == "fast", 0.1).when(volatility == "medium", 0.05).otherwise(0.0)).otherwise(0.0)
    return rel, rule, F.round(F.least(table[rule] + extra, F.lit(1.0)), 3)


#: which declared predicate an event type behaves like
BEHAVES_LIKE = {"click": "role", "purchase": "employer", "error": "salary", "signup": "birthday", "view": "preference"}


def declared(predicate: Column, like: dict[str, str] | None = None) -> tuple[Column, Column, Column]:
    """(cardinality, behaviour, volatility) of a predicate, null if nobody declared it."""
    names = BEHAVES_LIKE if like is None else like
    s = semantics()[F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[predicate]]
    return s[0], s[1], s[2]


def adjacent_relations(claims: DataFrame, like: dict[str, str] | None = None) -> DataFrame:
    """Each claim against the one before it in its slot."""
    w = Window.partitionBy(*SLOT).orderBy(*ORDER)
    prior = claims.withColumn("held", F.lag("bucket").over(w)).withColumn("held_at", F.lag("observed_at").over(w)).where("held is not null")
    rel, rule, conf = relation(F.col("held"), F.col("bucket"), F.col("kind"), *declared(F.col("predicate"), like), F.col("held_at"), F.col("observed_at"))
    return prior.select("event_id", *SLOT, rel.alias("relation"), rule.alias("rule"), conf.alias("confidence"))


def held_relations(claims: DataFrame, like: dict[str, str] | None = None) -> DataFrame:
    """Each claim against the one held when it came: event_id, subject, predicate, relation, held (after it).

    The first claim of a slot, corrections, and supersessions of a revisable single-valued predicate are what is held; all others
    leave it. So the held claim is the last such one before: windows over the slot, no fold. A supersession replaces only what
    was held at an earlier time; of several at one time the first counts.
    """
    cardinality, behaviour, volatility = declared(F.col("predicate"), like)
    line = Window.partitionBy(*SLOT).orderBy(*ORDER)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    same_time = Window.partitionBy(*SLOT, "observed_at").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(line) == 1
    may = first | (F.col("kind") == "correct") | ((F.col("kind") == "supersede") & F.coalesce((cardinality == "one") & (behaviour != "immutable"), F.lit(False)))
    rows = claims.select("event_id", *SLOT, "bucket", "kind", "observed_at").withColumn("first", first).withColumn("may", may)
    late = F.coalesce(F.max(F.col("may").cast("int")).over(same_time), F.lit(0)) > 0
    rows = rows.withColumn("sets", F.col("may") & ((F.col("kind") != "supersede") | F.col("first") | ~late))
    held = F.last(F.when(F.col("sets"), F.struct("bucket", "observed_at")), ignorenulls=True).over(before)
    rel, _, _ = relation(F.col("was.bucket"), F.col("bucket"), F.col("kind"), cardinality, behaviour, volatility, F.col("was.observed_at"), F.col("observed_at"))
    now = F.when(F.col("sets"), F.col("bucket")).otherwise(F.col("was.bucket"))
    return rows.withColumn("was", held).select("event_id", *SLOT, F.when(F.col("first"), "FIRST").otherwise(rel).alias("relation"), now.alias("held"))


def current_state(transitions: DataFrame) -> DataFrame:
    """The last transition of each claim that isn't a mere confirmation. transitions: claim, to_state, seq."""
    real = transitions.where(F.col("to_state") != "RECONFIRMED")
    return real.groupBy("claim").agg(F.max_by("to_state", "seq").alias("state"), F.count("*").alias("transitions"))


def world_snapshot(facts: DataFrame, at: Column) -> DataFrame:
    """Of each (entity, attribute) the fact with the latest start, then the highest confidence, then the first ingested."""
    w = Window.partitionBy("entity", "attribute").orderBy(F.desc("valid_from"), F.desc("confidence"), "seq")
    return facts.where(F.col("valid_from") <= at).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def selected(memories: DataFrame, questions: DataFrame, rescue: bool = False) -> DataFrame:
    """The memories that a claim history is derived from. memories: memory_id, entity, slot (both null in older rows), content, observed_at,
    event_id, bucket, kind. questions: question_id, subject, predicate. Adds by: how each was selected.

    Rows with a structured entity or slot are selected by equality alone; older ones by the subject's words in the text. A row without a slot is taken
    only with rescue, and only if its text names the predicate: it never competes with structured rows of the same question.
    """
    from tidemark.operators.planner import predicate

    found, _, _ = predicate(F.col("content"))
    rows = memories.withColumn("named", F.when(F.col("slot").isNull(), found))
    exact = rows.where("entity is not null and slot is not null").join(questions, (F.col("entity") == F.col("subject")) & (F.col("slot") == F.col("predicate"))).withColumn("by", F.lit("structured"))
    words = F.array_distinct(F.split(F.lower(F.trim("subject")), r"\s+"))
    asked = questions.withColumn("word", words[0]).withColumn("words", words)
    tokens = F.array_distinct(F.split(F.lower("content"), r"[^\p{L}\p{M}\p{N}]+"))
    older = rows.where("entity is null or slot is null").withColumn("tokens", tokens).select("*", F.explode("tokens").alias("word"))
    met = older.join(asked, "word").where(F.size(F.array_except("words", "tokens")) == 0).where(F.col("entity").isNull() | (F.col("entity") == F.col("subject")))
    met = met.where((F.col("slot") == F.col("predicate")) | (F.col("slot").isNull() & (F.col("named") == F.col("predicate")) & F.lit(rescue)))
    met = met.withColumn("by", F.when(F.col("slot").isNull(), "rescued").otherwise("text")).drop("word", "words", "tokens")
    met = met.join(exact.select("question_id").distinct().withColumn("better", F.lit(True)), "question_id", "left").where(~((F.col("by") == "rescued") & F.coalesce("better", F.lit(False)))).drop("better")
    return exact.select("question_id", "memory_id", "by").unionByName(met.select("question_id", "memory_id", "by"))


def with_stored(history: DataFrame, stored: DataFrame) -> DataFrame:
    """history: spans with event_id. stored: event_id, stored_from, stored_to. Stored windows override derived ones; an empty window
    means corrected."""
    j = history.join(stored, "event_id", "left")
    start, end = F.coalesce("stored_from", "valid_from"), F.coalesce("stored_to", "valid_to")
    empty = F.coalesce(start == end, F.lit(False))
    return j.withColumn("valid_from", start).withColumn("valid_to", end).withColumn("status", F.when(empty, "corrected").when(F.col("disputed"), "disputed").when(end.isNotNull(), "superseded").otherwise("open")).withColumn("retracted", empty).drop("stored_from", "stored_to")
