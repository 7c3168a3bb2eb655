"""Context blocks and packets: put, evict, promote, list, cache; claims and world facts as packets; belief and memory ranks with all parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators.matching import ranked

# fixed values: memory types that speak of the world; what an agent's mode prefers; a memory's meaning without a vector
WORLD_TYPES = ("world_state", "semantic", "relational", "spatial", "social")
MODES = {"debug": {"exception": 0.25, "procedural": 0.25}, "implement": {"procedural": 0.35, "semantic": 0.18}, "refactor": {"semantic": 0.32, "procedural": 0.12}, "deploy": {"exception": 0.3, "procedural": 0.3}}
NO_VECTOR = 0.6


def put(blocks: DataFrame) -> DataFrame:
    """blocks: block_id, tenant, workspace, content_hash, memories (array), trust, importance, reuse, seq. One block for each content
    of a workspace: the first one's identity, all sources, the best of each score."""
    best = lambda c: F.max(c).alias(c)
    g = blocks.groupBy("tenant", "workspace", "content_hash").agg(F.min_by("block_id", "seq").alias("block_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("memories")))).alias("memories"), best("trust"), best("importance"), best("reuse"), (F.count("*") - 1).alias("merged"))
    return g


def evicted(blocks: DataFrame, now: Column) -> DataFrame:
    """Blocks that haven't run out. Without an end a block stays."""
    return blocks.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def promoted(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: block_id, tier, seq. Each block with its last move's tier; every move is an access."""
    last = moves.groupBy("block_id").agg(F.max_by("tier", "seq").alias("__tier"), F.count("*").alias("__moves"))
    return blocks.join(last, "block_id", "left").withColumn("tier", F.coalesce("__tier", "tier")).withColumn("access_count", F.col("access_count") + F.coalesce("__moves", F.lit(0))).drop("__tier", "__moves")


def listed(blocks: DataFrame, limit: int) -> DataFrame:
    """Of each tenant the blocks most likely to be used again, then the most important, then the most used."""
    return ranked(blocks, "tenant", [F.desc("reuse"), F.desc("importance"), F.desc("access_count"), "block_id"], limit)


def cached(entries: DataFrame, reads: DataFrame) -> DataFrame:
    """entries: key, tenant, block_ids, expires_at, seq; the last write of a key counts. reads: read_id, key, tenant, at. Of each read:
    hit, block_ids, and the accesses of the entry up to it."""
    last = entries.groupBy("key", "tenant").agg(F.max_by(F.struct("block_ids", "expires_at"), "seq").alias("e"))
    j = reads.join(last, ["key", "tenant"], "left")
    hit = F.col("e").isNotNull() & (F.col("e.expires_at").isNull() | (F.col("e.expires_at") > F.col("at")))
    w = Window.partitionBy("key", "tenant").orderBy("at", "read_id").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("hit", hit).select("read_id", "key", "hit", F.when(F.col("hit"), F.col("e.block_ids")).alias("block_ids"), F.sum(F.col("hit").cast("int")).over(w).alias("accesses"))


def claim_packets(memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence: memory_id, event_id, source, side (support, counter). What may be said of each memory, with its proof: independent
    sources, and whether high-risk use is allowed, else why not."""
    e = evidence.groupBy("memory_id").agg(F.array_sort(F.collect_set(F.when(F.col("side") == "support", F.col("event_id")))).alias("support"), F.array_sort(F.collect_set(F.when(F.col("side") == "counter", F.col("event_id")))).alias("counter"), F.count_distinct(F.when(F.col("side") == "support", F.col("source"))).alias("independent_sources"))
    rows = memories.join(e, "memory_id", "left").withColumn("independent_sources", F.coalesce("independent_sources", F.lit(0)))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("support", F.coalesce("support", none)).withColumn("counter", F.coalesce("counter", none))
    reasons = F.array_sort(F.array_compact(F.array(F.when(F.col("independent_sources") < 2, "too_few_sources"), F.when(F.size("counter") > 0, "counterevidence"), F.when(F.col("epistemic_status") == "simulated", "simulated"), F.when(F.col("verification_status") == "rejected", "rejected"))))
    return rows.select("memory_id", "epistemic_status", "verification_status", "confidence", "support", "counter", "independent_sources", (F.size(reasons) == 0).alias("high_risk_eligible"), reasons.alias("reasons"))


def world_facts(memories: DataFrame) -> DataFrame:
    """memories: memory_id, memory_type, structured (JSON). Facts about the world: of the types that speak of it, with an entity, an
    attribute and a value."""
    get = lambda f: F.trim(F.coalesce(F.get_json_object("structured", f"$.{f}"), F.lit("")))
    return memories.where(F.col("memory_type").isin(*WORLD_TYPES) & (get("entity") != "") & (get("attribute") != "") & F.get_json_object("structured", "$.value").isNotNull()).select("memory_id", get("entity").alias("entity"), get("attribute").alias("attribute"), F.get_json_object("structured", "$.value").alias("value"))


def state_boost(rows: dict[str, Column], state: dict[str, str | bool]) -> Column:
    """How much better a memory fits the agent's state: rows names its hints, task, workspace, version, risk, stress and type."""
    out, same = F.lit(1.0), {"task": 0.25, "workspace": 0.2, "version": 0.15, "risk": 0.2, "stress": 0.15}
    if state.get("mode"):
        out = out + F.when(F.array_contains(rows["hints"], state["mode"]), 0.45).otherwise(0.0) + S.lookup(rows["type"], MODES.get(state["mode"], {"": 0.0}))
    for f, v in same.items():
        if state.get(f):
            out = out + F.when(rows[f] == state[f], v).otherwise(0.0)
    if state.get("prefer_exception"):
        out = out + F.when(rows["type"] == "exception", 0.6 + (0.12 if state.get("mode") == "refactor" else 0.0)).otherwise(0.0)
    return F.coalesce(out, F.lit(1.0))


def memory_score(dot: Column, overlap: Column, importance: Column, decay: Column, boost: Column) -> Column:
    """Rank of a long-term memory: meaning (a constant without a vector) and shared words, weighed by importance, age and state."""
    meaning = F.when(dot.isNull(), NO_VECTOR).otherwise(F.greatest(F.lit(0.0), dot))
    return (meaning + F.least(0.3 * overlap, F.lit(0.9))) * (0.8 + importance / 25) * decay * boost


def belief_scores(rules: DataFrame, edges: DataFrame, terms: list[str], preferred: str, top: int) -> DataFrame:
    """rules: rule_id, tenant, text, state, scope, confidence, supports, contradictions. edges: source, relation, target. The live rules
    that fit the query's terms best, with the numbers of edges of each kind at them."""
    live = rules.where(~F.col("state").isin("deprecated", "archived"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    lexical = 0.6 + F.least(F.lit(0.4), F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms]))) / max(len(terms), 1)) if terms else F.lit(0.6)
    score = lexical * (0.5 + F.col("confidence")) * (1 + F.least(F.lit(0.5), 0.08 * F.col("supports"))) * F.greatest(F.lit(0.45), 1 - 0.1 * F.col("contradictions"))
    score = F.when(F.col("state").isin("stable", "reinforced"), score + 0.2).when(F.col("state") == "challenged", 0.55 * score).otherwise(score)
    score = F.round(score + F.when(F.lower("scope") == preferred, 0.15).otherwise(0.0), 6)
    best = ranked(live.withColumn("score", score), "tenant", [F.desc("score"), "rule_id"], top)
    ends = edges.select(F.col("target").alias("rule_id"), F.when(F.col("relation") == "supports", "evidence").when(F.col("relation") == "conflicts_with", "conflict").when(F.col("relation") == "governed_exception_for", "excepted_by").alias("kind")).unionByName(
        edges.select(F.col("source").alias("rule_id"), F.when(F.col("relation") == "conflicts_with", "conflict").when(F.col("relation") == "governed_exception_for", "exception_for").alias("kind")))
    n = ends.where("kind is not null").groupBy("rule_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("evidence", "conflict", "excepted_by", "exception_for")])
    return best.join(n, "rule_id", "left").na.fill(0, ["evidence", "conflict", "excepted_by", "exception_for"]).select("tenant", "rule_id", "score", "rank", "evidence", "conflict", "excepted_by", "exception_for", F.when(F.col("state") == "challenged", "require_approval").otherwise("").alias("fallback"))


def bundle(parts: dict[str, DataFrame], by: str, top: int, guard: Column) -> DataFrame:
    """parts: name -> rows of by, id, score, lineage (array of source ids), and what the guard reads. The best of each store for each
    query behind one guard, with the sources they rest on: by, part, id, score, rank, sources."""
    out = None
    for name, rows in parts.items():
        best = ranked(rows.where(guard), by, [F.desc("score"), "id"], top).select(by, F.lit(name).alias("part"), "id", "score", "rank", F.size("lineage").alias("sources"))
        out = best if out is None else out.unionByName(best)
    return out


def survivors(notes: DataFrame, ttl: int) -> DataFrame:
    """notes: note_id, state, nights, seq. All raw notes that outlived their nights, the oldest first: with their place."""
    alive = notes.where((F.col("state") == "raw") & (F.col("nights") > ttl))
    return alive.select("note_id", "nights", "seq").orderBy("seq", "note_id")


def neighbourhood(edges: DataFrame, types: DataFrame) -> DataFrame:
    """edges: source, relation, target. types: node, node_type. Of each node its neighbours by type, in either direction."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    return both.join(types.select(F.col("node").alias("target"), "node_type"), "target").groupBy("source", "node_type").agg(F.count("*").alias("n"), F.min("target").alias("first"))


