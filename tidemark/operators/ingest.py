"""From observations to stored memories: one builder for all writers, links, gates, labels, learning records, fan-out, write-back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import facts as X
from tidemark.operators import governance as G
from tidemark.operators import rules as R

# fixed values: what a projection intent leaves open; hints by words; thresholds of consolidation
INTENT = {"memory_type": "episodic", "confidence": 0.6, "importance": 0.5, "salience": 0.5, "utility": 0.5, "lifecycle_state": "proposed", "verification_status": "unverified"}
HINTS = (("debug", ("error", "failed", "panic", "traceback", "exception")), ("implement", ("implement", "write", "create", "build feature")), ("refactor", ("refactor", "cleanup", "rename", "extract")), ("deploy", ("deploy", "release", "production", "rollback", "migration")))
TOPIC_HINTS = ("git", "dependency", "build")
FAILURE = ("failed", "panic", "critical", "error", "exception")
MERGE_AT, REPLAY, DURABLE, WEAKER = 0.93, 24, 4.0, 0.6
RELABEL_BATCH, RELABEL_BATCHES = 10, 20
DEFAULT_CONFIDENCE = 0.7
COMPLETIONS, ASSESSMENTS = ("course-completion", "course_completion", "certificate"), ("quiz", "exam", "assessment", "graded_quiz", "test")


def built(events: DataFrame) -> DataFrame:
    """events: event_id, tenant, workspace, trust_tier, observed_at, epistemic_status, content, intent (JSON or null). The memories
    they make: what the intent leaves open gets its default, scores are clamped, provenance is the event."""
    get = lambda f: F.get_json_object("intent", f"$.{f}")
    score = lambda f: S.clamp(F.coalesce(F.try_to_number(get(f), F.lit("S9999.999999")).cast("double"), F.lit(INTENT[f])))
    return events.select(
        F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("memory_id"), "tenant", "workspace", F.coalesce(get("memory_type"), F.lit(INTENT["memory_type"])).alias("memory_type"), "content", F.array(F.col("event_id")).alias("source_event_ids"), "trust_tier", "observed_at",
        F.coalesce(get("lifecycle_state"), F.lit(INTENT["lifecycle_state"])).alias("lifecycle_state"), *[score(f).alias(f) for f in ("confidence", "importance", "salience", "utility")],
        F.coalesce(get("epistemic_status"), F.col("epistemic_status")).alias("epistemic_status"), F.coalesce(get("verification_status"), F.lit(INTENT["verification_status"])).alias("verification_status"))


def links(memories: DataFrame, above: int | None = None, mark: str = "memory_id") -> DataFrame:
    """event_id, memory_id, version, tenant: a row for each source of each memory, of those above the mark only. One scan; the
    filter reaches it."""
    rows = memories if above is None else memories.where(F.col(mark) > above)
    return rows.select(F.explode("source_event_ids").alias("event_id"), "memory_id", "version", "tenant").distinct()


def gated(items: DataFrame, source: Column) -> DataFrame:
    """Adds fate (quarantined by the immune gate, blocked by the promotion rules, accepted), reasons, and the content and scores as
    they would be written."""
    rows = G.promotion(G.immune(items, source))
    fate = F.when(F.col("quarantined"), "quarantined").when(F.size("blocked") > 0, "blocked").otherwise("accepted")
    out = rows.withColumn("fate", fate).withColumn("content", T.redacted(F.col("content")))
    for c in ("confidence", "utility", "salience"):
        out = out.withColumn(c, S.clamp(F.col(c)))
    return out


def record_kind(r: Column) -> Column:
    """completion, assessment or lesson, of a learning record (JSON)."""
    low = lambda f: F.lower(F.trim(F.coalesce(F.get_json_object(r, f"$.{f}"), F.lit(""))))
    some = lambda *fs: F.coalesce(*[F.when(low(f) != "", True) for f in fs], F.lit(False))
    done = low("item_type").isin(*COMPLETIONS) | some("certificate_id") | F.get_json_object(r, "$.final_grade_percent").isNotNull()
    return F.when(done, "completion").when(low("type").isin(*ASSESSMENTS) | some("item_id", "item_title", "item_type"), "assessment").otherwise("lesson")


def record_items(records: DataFrame) -> DataFrame:
    """records: id, record (JSON). id, kind, class, text, confidence: a row for each thing that a record says.

    A lesson gives its facts, an assessment its score and an item for each wrong attempt, a completion its grade. A confidence
    that is no number from 0 to 1 is replaced by the default; the record isn't lost.
    """
    r, kind = F.col("record"), record_kind(F.col("record"))
    given = F.try_to_number(F.get_json_object(r, "$.confidence"), F.lit("S9999.999999")).cast("double")
    confidence = F.when(given.between(0, 1), given).otherwise(DEFAULT_CONFIDENCE)
    attempts = F.from_json(F.get_json_object(r, "$.attempts"), "array<struct<question string, correct boolean>>")
    item = lambda c, text: F.struct(F.lit(c).alias("class"), text.alias("text"))
    wrong = F.transform(F.filter(F.coalesce(attempts, F.array().cast("array<struct<question string, correct boolean>>")), lambda a: ~a["correct"]), lambda a: F.struct(F.lit("mistake").alias("class"), a["question"].alias("text")))
    score = F.array(item("score", F.concat_ws(" ", F.get_json_object(r, "$.course"), F.get_json_object(r, "$.score"))))
    lessons = F.transform(F.from_json(F.coalesce(F.get_json_object(r, "$.summary"), F.lit("[]")), "array<string>"), lambda s: F.struct(F.lit("lesson_fact").alias("class"), s.alias("text")))
    grade = F.array(item("completion", F.concat_ws(" ", F.get_json_object(r, "$.course"), F.get_json_object(r, "$.final_grade_percent"))))
    rows = records.withColumn("kind", kind).withColumn("confidence", confidence)
    things = F.when(F.col("kind") == "completion", grade).when(F.col("kind") == "assessment", F.concat(score, wrong)).otherwise(lessons)
    return rows.select("id", "kind", "confidence", F.explode(things).alias("x")).select("id", "kind", "x.class", "x.text", "confidence")


def labelled(turns: DataFrame, label: Callable[[Column], tuple[Column, Column]] = T.cheap_label) -> DataFrame:
    """turns: id, content. Adds what the ingest decides of each: compact content, junk, importance, exact fact, anchor, and the
    sinks it goes to. label may be any pair of expressions (or UDFs) of a text."""
    rows = turns.withColumn("content", T.compacted(F.col("content")))
    junk, importance = label(F.col("content"))
    rows = rows.withColumn("junk", junk).withColumn("importance", importance).withColumn("fact", X.extracted(F.col("content"))).withColumn("anchor", X.anchored(F.col("content")))
    sinks = F.array_compact(F.array(F.lit("episode"), F.when(F.col("fact").isNotNull(), "exact"), F.when(~F.col("junk"), "working"), F.lit("audit"), F.when(F.col("anchor").isNotNull(), "anchor")))
    return rows.withColumn("sinks", sinks)


def relabelled(rows: DataFrame, label: Callable[[Column], tuple[Column, Column]], size: int = RELABEL_BATCH, batches: int = RELABEL_BATCHES) -> DataFrame:
    """rows: id, content, label (null: none yet). The next rows without a label in batches, as a model call takes them, labelled.
    The number of batches of a call is the operator's budget; the next call takes the following ones."""
    first = rows.where(F.col("label").isNull()).orderBy("id").limit(size * batches)
    junk, importance = label(F.col("content"))
    n = F.row_number().over(Window.orderBy("id")) - 1  # within the budget: a bounded number of rows
    return first.select("id", F.floor(n / size).cast("int").alias("batch"), junk.alias("junk"), importance.alias("importance"))


def hints(content: Column, topic: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(T.any_of(content, words), name) for name, words in HINTS], *[F.when(F.lower(topic).isin(*TOPIC_HINTS), h) for h in ("debug", "deploy")]))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.lit("implement")))


def fanned(compiled: DataFrame) -> DataFrame:
    """compiled: id, content, topic, importance, user_state, semantic, procedural, episodic, exception (may be empty). The memories it
    makes, each with mode hints, risk and stress; an episode weighs one less, an exception 8."""
    i = F.col("importance")
    one = lambda kind, text, weight: F.struct(F.lit(kind).alias("memory_type"), F.col(text).alias("text"), weight.cast("double").alias("weight"))
    parts = F.array(one("semantic", "semantic", i), one("procedural", "procedural", i), one("episodic", "episodic", F.greatest(F.lit(1), i - 1)))
    parts = F.when(F.trim(F.coalesce("exception", F.lit(""))) != "", F.concat(parts, F.array(one("exception", "exception", F.lit(8))))).otherwise(parts)
    risk = F.when(i >= 8, "high").when(i >= 5, "medium").otherwise("low")
    stress = F.when(T.any_of(F.col("content"), FAILURE), "failure").otherwise(F.coalesce("user_state", F.lit("normal")))
    return compiled.select("id", "topic", hints(F.col("content"), F.col("topic")).alias("hints"), risk.alias("risk"), stress.alias("stress"), F.explode(parts).alias("m")).select("id", "topic", "hints", "risk", "stress", "m.*")


def reconsolidated(items: DataFrame, by: str, processed: DataFrame | None = None, replay: int = REPLAY, merge_at: float = MERGE_AT) -> DataFrame:
    """items: by, id, memory_type, scope, text, embedding, durability, importance, score. After a night: id, fate (merged, weakened,
    strengthened, unchanged), durability, importance of each group's `replay` best by score.

    Pairs in order of score, of one type but anchors, and not processed before (processed: signature): alike ones without
    a conflict merge into the more durable, the first on ties; of contradicting ones the weaker, by durability, then importance, loses
    durability and importance. Survivors gain 0.1. Each merge changes what follows, so a group's bounded few are folded in order.
    """
    rows = R.described(items.where(F.col("embedding").isNotNull()))
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    best = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= replay)
    best = best.select(by, "id", "n", "memory_type", "scope", "polarity", "core", "embedding", F.col("durability").cast("double").alias("durability"), F.col("importance").cast("double").alias("importance"))
    if processed is not None:  # the signatures of a group's members only
        ids = best.select(by, "id")
        mine = processed.select(F.split("signature", "::").alias("p"), "signature").select("signature", F.explode("p").alias("sid")).join(ids.select(by, F.col("id").cast("string").alias("sid")), "sid").groupBy(by).agg(F.collect_set("signature").alias("seen"))
        best = best.join(mine, by, "left")
    else:
        best = best.withColumn("seen", F.lit(None).cast("array<string>"))
    schema = f"{by} {items.schema[by].dataType.simpleString()}, id long, fate string, durability double, importance double"
    return best.groupBy(by).applyInPandas(lambda g: _night(g, by, merge_at), schema)


def _night(g: pd.DataFrame, by: str, merge_at: float) -> pd.DataFrame:
    import numpy as np

    g = g.sort_values("n")
    seen = next((set(s) for s in g["seen"] if s is not None), set())
    v = np.stack([np.asarray(x, float) for x in g["embedding"]])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    rows = [dict(zip(g.columns, r, strict=True)) for r in g.itertuples(index=False)]
    core = [frozenset(r["core"]) for r in rows]
    start = [r["durability"] for r in rows]
    fate = ["unchanged"] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if fate[i] == "merged" or fate[j] == "merged" or a["memory_type"] != b["memory_type"] or a["memory_type"] == "anchor":
                continue
            if "::".join(sorted((str(a["id"]), str(b["id"])))) in seen:
                continue
            opposed = {a["polarity"], b["polarity"]} == {"positive", "negative"} and a["scope"] == b["scope"]
            conflict = opposed and core[i] and core[j] and len(core[i] & core[j]) >= 0.6 * max(1, min(len(core[i]), len(core[j])))
            if conflict:
                low = a if (a["durability"], a["importance"]) <= (b["durability"], b["importance"]) else b
                low["durability"], low["importance"] = max(1.0, low["durability"] * WEAKER), max(0.0, low["importance"] - 1)
                fate[i if low is a else j] = "weakened"
            elif v[i] @ v[j] >= merge_at:
                win, lose = (i, j) if a["durability"] >= b["durability"] else (j, i)
                fate[lose] = "merged"
    for k, r in enumerate(rows):
        if fate[k] != "merged":
            new = min(DURABLE, r["durability"] + 0.1)
            fate[k] = "strengthened" if fate[k] == "unchanged" and new != start[k] else fate[k]
            r["durability"] = new
    return pd.DataFrame({by: [r[by] for r in rows], "id": [r["id"] for r in rows], "fate": fate, "durability": [round(r["durability"], 6) for r in rows], "importance": [r["importance"] for r in rows]})


def durable(items: DataFrame) -> DataFrame:
    """What reconsolidation reads: live memories, with what older ones lack filled in. Exceptions are high risk."""
    live = items.where(F.col("lifecycle_state") != "archived")
    return live.withColumn("access_count", F.coalesce("access_count", F.lit(0))).withColumn("durability", F.coalesce("durability", S.durability(F.col("access_count")))).withColumn("risk", F.when(F.col("memory_type") == "exception", "high").otherwise(F.coalesce("risk", F.lit("medium"))))


def backfilled(rows: DataFrame, embed: Column | None = None) -> DataFrame:
    """Fills in what older episodes lack: the plain text, and the vector by an injected expression. Others are left as they are."""
    out = rows.withColumn("filled", F.col("normal").isNull()).withColumn("normal", F.coalesce("normal", X.plain(F.col("text"))))
    return out if embed is None else out.withColumn("embedding", F.coalesce("embedding", embed))


def default_triples(c: Column) -> Column:
    """Subject, relation, object of "X is/has/uses Y" sentences; a stand-in for a model's extractor."""
    said = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{L}[\p{L}\p{N} ]{0,40}? (?:is|has|uses) \p{L}[\p{L}\p{N} ]{0,40})(?=[.!?\n]|$)"), F.lit(1))
    part = lambda s, n: F.trim(F.regexp_extract(s, r"^(.*?) (is|has|uses) (.*)$", n))
    return F.transform(said, lambda s: F.struct(part(s, 1).alias("source"), part(s, 2).alias("relation"), part(s, 3).alias("target")))


def graph_of(docs: DataFrame, triples: Callable[[Column], Column] = default_triples) -> DataFrame:
    """docs: id, text. Edges from the triples of an injected extractor: source, relation, target, mentions, first."""
    t = docs.select("id", F.explode(triples(F.col("text"))).alias("t")).select("id", F.lower("t.source").alias("source"), "t.relation", F.lower("t.target").alias("target"))
    return t.where("source <> '' and target <> '' and source <> target").groupBy("source", "relation", "target").agg(F.count("*").alias("mentions"), F.min("id").alias("first"))


def tree_level(leaves: DataFrame, group: str, order: str, fanout: int, summarise: Callable[[Column], Column] = T.extractive_summary) -> DataFrame:
    """leaves: group, order, text. The next level of a coverage tree: a node for every `fanout` leaves, its text by an injected
    summariser of the leaves' texts in order, and the span it covers."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    node = leaves.withColumn("node", F.floor(n / fanout).cast("int"))
    line = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return node.groupBy(group, "node").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("leaves"), line.alias("texts")).withColumn("text", summarise(F.col("texts"))).drop("texts")


def written_back(clusters: DataFrame, merge: Callable[[Column], Column] = T.extractive_summary) -> DataFrame:
    """clusters: cluster, memory_id, text, source_event_ids, confidence. One memory a cluster: its members, the union of their
    sources, the lowest confidence, and a text by an injected merger. Members stay; the marker names them."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("memory_id", "text"))), lambda x: x["text"])
    return clusters.groupBy("cluster").agg(F.array_sort(F.collect_set("memory_id")).alias("consolidated_from"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_event_ids")))).alias("source_event_ids"), F.min("confidence").alias("confidence"), line.alias("texts")).withColumn("text", merge(F.col("texts"))).drop("texts")


def dreamt(outcomes: DataFrame, least: int = 3, most_failures: float = 0.25) -> DataFrame:
    """outcomes: goal, steps, success, verified. Of each goal the commonest successful step sequence, if enough runs have it and few
    of the goal's runs failed; the rest is rejected, with the reason's figures."""
    seen = outcomes.where("verified").withColumn("goal", F.lower(F.trim("goal")))
    per = seen.groupBy("goal", "steps").agg(F.count_if("success").alias("won"), F.count_if(~F.col("success")).alias("lost"))
    g = per.groupBy("goal").agg(F.max(F.struct("won", "steps")).alias("best"), F.sum("lost").alias("failed"), F.sum(F.col("won") + F.col("lost")).alias("n"))
    ratio, support = F.col("failed") / F.col("n"), F.col("best.won")
    ok = (support >= least) & (ratio <= most_failures)
    confidence = F.when(ok, F.round(F.least(0.55 + 0.08 * support - 0.30 * ratio, F.lit(0.97)), 6))
    state = F.when(ok, F.when((support >= 5) & (F.col("failed") == 0), "stable").otherwise("reinforced"))
    return g.select("goal", F.when(ok, "kept").otherwise("rejected").alias("fate"), support.alias("support"), F.round(ratio, 6).alias("failure_ratio"), F.when(ok, F.col("best.steps")).alias("steps"), confidence.alias("confidence"), state.alias("state"))
