"""Queries of context blocks, packets, and ranks with all their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import packets as K
from tidemark.operators.matching import ranked
from tidemark.plans.knowledge import pick
from tidemark.plans.registry import query
from tidemark.sources.adapters import MEMORIES_SQL, memories, table


@query("block_put", "SELECT source AS tenant, lang AS workspace, doc_id % 7 AS content_hash, min(doc_id) AS block_id, array_to_string(list_sort(list_distinct(list(doc_id // 3))), ',') AS memories, max(doc_id % 5) / 5.0::DOUBLE AS trust, max(doc_id % 11) / 11.0::DOUBLE AS importance, max(doc_id % 3) / 3.0::DOUBLE AS reuse, count(*) - 1 AS merged FROM documents GROUP BY ALL")
def block_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of equal content become one."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("block_id"), F.col("source").alias("tenant"), F.col("lang").alias("workspace"), (i % 7).alias("content_hash"), F.array(F.floor(i / 3)).alias("memories"), (i % 5 / 5.0).alias("trust"), (i % 11 / 11.0).alias("importance"), (i % 3 / 3.0).alias("reuse"), i.alias("seq"))
    return K.put(d).withColumn("memories", F.array_join(F.col("memories").cast("array<string>"), ","))


_BLOCKS = "b AS (SELECT doc_id AS block_id, source AS tenant, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 END AS expires_at, CASE WHEN doc_id % 4 = 0 THEN 'hot' ELSE 'warm' END AS tier, doc_id % 3 / 3.0::DOUBLE AS reuse, doc_id % 11 / 11.0::DOUBLE AS importance, doc_id % 6 AS access_count FROM documents)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("block_id"), F.col("source").alias("tenant"), F.when(i % 3 != 0, i % 50).alias("expires_at"), F.when(i % 4 == 0, "hot").otherwise("warm").alias("tier"), (i % 3 / 3.0).alias("reuse"), (i % 11 / 11.0).alias("importance"), (i % 6).alias("access_count"))


@query("block_lifecycle", f"WITH {_BLOCKS} SELECT block_id, CASE WHEN block_id % 10 = 0 THEN 'cold' WHEN block_id % 5 = 0 THEN 'hot' ELSE tier END AS tier, access_count + CASE WHEN block_id % 10 = 0 THEN 2 WHEN block_id % 5 = 0 THEN 1 ELSE 0 END AS access_count FROM b WHERE expires_at IS NULL OR expires_at > 20")
def block_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left once blocks ran out, with the tiers they were moved to."""
    b = _blocks(spark, sf_dir)
    moves = b.where("block_id % 5 = 0").select("block_id", F.lit("hot").alias("tier"), F.lit(1).alias("seq")).unionByName(b.where("block_id % 10 = 0").select("block_id", F.lit("cold").alias("tier"), F.lit(2).alias("seq")))
    return K.promoted(K.evicted(b, F.lit(20)), moves).select("block_id", "tier", "access_count")


@query("block_listing", f"WITH {_BLOCKS} SELECT * FROM (SELECT tenant, block_id, row_number() OVER (PARTITION BY tenant ORDER BY reuse DESC, importance DESC, access_count DESC, block_id) AS rank FROM b) WHERE rank <= 6")
def block_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.listed(_blocks(spark, sf_dir), 6).select("tenant", "block_id", "rank")


@query("packet_cache", """WITH w AS (SELECT event_id % 20 AS key, event_id AS seq, 'p' || event_id AS block_ids, CASE WHEN event_id % 3 <> 0 THEN event_id % 400 END AS expires_at FROM events WHERE event_type = 'view' AND event_id % 20 <> 7), e AS (SELECT key, max(struct_pack(s := seq, b := block_ids, x := expires_at)) AS e FROM w GROUP BY 1),
r AS (SELECT event_id AS read_id, event_id % 20 AS key, event_id % 500 AS moment FROM events WHERE event_type = 'click'), j AS (SELECT r.*, e IS NOT NULL AND (e.x IS NULL OR e.x > moment) AS hit, e FROM r LEFT JOIN e USING (key))
SELECT read_id, key, hit, CASE WHEN hit THEN e.b END AS block_ids, (sum(hit::INTEGER) OVER (PARTITION BY key ORDER BY moment, read_id))::BIGINT AS accesses FROM j""")
def packet_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a cache of packets, some of which have run out."""
    e = table(spark, sf_dir, "events")
    i, tenant = F.col("event_id"), F.lit("t").alias("tenant")
    writes = e.where("event_type = 'view' and event_id % 20 <> 7").select((i % 20).alias("key"), tenant, F.concat(F.lit("p"), i.cast("string")).alias("block_ids"), F.when(i % 3 != 0, i % 400).alias("expires_at"), i.alias("seq"))
    return K.cached(writes, e.where("event_type = 'click'").select(i.alias("read_id"), (i % 20).alias("key"), tenant, (i % 500).alias("at")))


@query("claim_packets", f"""WITH {MEMORIES_SQL}, e AS (SELECT event_id % 1000 AS memory_id, event_id, user_id AS source, CASE WHEN event_type = 'error' THEN 'counter' ELSE 'support' END AS side FROM events), g AS (SELECT memory_id, list_sort(list(event_id) FILTER (side = 'support')) AS s, list_sort(list(event_id) FILTER (side = 'counter')) AS c, count(DISTINCT source) FILTER (side = 'support') AS n FROM e GROUP BY 1),
r AS (SELECT m.memory_id, epistemic_status, verification_status, confidence, coalesce(array_to_string(s, ','), '') AS support, coalesce(array_to_string(c, ','), '') AS counter, coalesce(n, 0) AS independent_sources, list_filter([CASE WHEN len(coalesce(c, [])) > 0 THEN 'counterevidence' END, CASE WHEN verification_status = 'rejected' THEN 'rejected' END, CASE WHEN epistemic_status = 'simulated' THEN 'simulated' END, CASE WHEN coalesce(n, 0) < 2 THEN 'too_few_sources' END], lambda x: x IS NOT NULL) AS why FROM memories m LEFT JOIN g USING (memory_id))
SELECT * EXCLUDE (why), len(why) = 0 AS high_risk_eligible, array_to_string(why, ',') AS reasons FROM r""")
def claim_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as claims with their proof."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("memory_id"), "event_id", F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", "counter").otherwise("support").alias("side"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    p = K.claim_packets(memories(spark, sf_dir), e)
    return p.select("memory_id", "epistemic_status", "verification_status", "confidence", joined("support"), joined("counter"), "independent_sources", "high_risk_eligible", joined("reasons"))


STRUCTURED = ['{"entity": "unit 7", "attribute": "protocol", "value": 9}', '{"entity": "unit 7", "attribute": " "}', '{"entity": "gate", "attribute": "colour", "value": "red"}', None, '{"entity": "", "attribute": "x", "value": 1}', '{"entity": "sea", "attribute": "depth"}']


@query("world_facts", f"WITH {MEMORIES_SQL} SELECT memory_id, CASE WHEN memory_id % 6 = 0 THEN 'unit 7' ELSE 'gate' END AS entity, CASE WHEN memory_id % 6 = 0 THEN 'protocol' ELSE 'colour' END AS attribute, CASE WHEN memory_id % 6 = 0 THEN '9' ELSE 'red' END AS value FROM memories WHERE memory_type IN ('semantic', 'relational') AND memory_id % 6 IN (0, 2)")
def world_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).withColumn("structured", pick(STRUCTURED, "memory_id"))
    return K.world_facts(m)


@query("belief_rank", f"""WITH {MEMORIES_SQL}, ru AS (SELECT memory_id AS rule_id, tenant, list_filter(list_distinct(string_split_regex(lower(content), '\\s+')), lambda w: w <> '') AS w, CASE lifecycle_state WHEN 'archived' THEN 'deprecated' ELSE lifecycle_state END AS state, workspace AS scope, confidence, reinforcement, contradiction FROM memories WHERE memory_type IN ('policy', 'causal')),
sc AS (SELECT *, (0.6 + least(0.4, len(list_intersect(w, ['the', 'of', 'und', 'que'])) / 4.0)) * (0.5 + confidence) * (1 + least(0.5, 0.08 * reinforcement)) * greatest(0.45, 1 - 0.1 * contradiction) AS base FROM ru WHERE state <> 'deprecated'),
fs AS (SELECT *, round((CASE WHEN state IN ('stable', 'reinforced') THEN base + 0.2 WHEN state = 'challenged' THEN 0.55 * base ELSE base END + CASE WHEN scope = 'en' THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS score FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY score DESC, rule_id) AS rank FROM fs),
ed AS (SELECT event_id % 500 AS s, CASE event_type WHEN 'purchase' THEN 'supports' WHEN 'error' THEN 'conflicts_with' WHEN 'signup' THEN 'governed_exception_for' ELSE 'other' END AS rel, event_id * 7 % 500 AS t FROM events)
SELECT tenant, rule_id, score, rank, (SELECT count(*) FROM ed WHERE t = rule_id AND rel = 'supports') AS evidence, (SELECT count(*) FROM ed WHERE t = rule_id AND rel = 'conflicts_with') + (SELECT count(*) FROM ed WHERE s = rule_id AND rel = 'conflicts_with') AS conflict, (SELECT count(*) FROM ed WHERE t = rule_id AND rel = 'governed_exception_for') AS excepted_by,
  (SELECT count(*) FROM ed WHERE s = rule_id AND rel = 'governed_exception_for') AS exception_for, CASE WHEN state = 'challenged' THEN 'require_approval' ELSE '' END AS fallback FROM rk WHERE rank <= 5""")
def belief_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by fit, evidence and state, with what supports, contests and excepts them."""
    m = memories(spark, sf_dir).where("memory_type in ('policy', 'causal')")
    rules = m.select(F.col("memory_id").alias("rule_id"), "tenant", F.col("content").alias("text"), F.when(F.col("lifecycle_state") == "archived", "deprecated").otherwise(F.col("lifecycle_state")).alias("state"), F.col("workspace").alias("scope"), "confidence", F.col("reinforcement").alias("supports"), F.col("contradiction").alias("contradictions"))
    kind = F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "error", "conflicts_with").when(F.col("event_type") == "signup", "governed_exception_for").otherwise("other")
    edges = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("source"), kind.alias("relation"), (F.col("event_id") * 7 % 500).alias("target"))
    return K.belief_scores(rules, edges, ["the", "of", "und", "que"], "en", 5)


BOOSTED = {"mode": "deploy", "workspace": "en", "risk": "high", "stress": "failure", "prefer_exception": True}


@query("l2_rank", f"""WITH {MEMORIES_SQL}, r AS (SELECT memory_id, tenant, (CASE WHEN embedding IS NULL THEN 0.6 ELSE greatest(0, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform((SELECT embedding FROM embeddings WHERE vec_id = 0), lambda x: x::DOUBLE))) END + least(0.3 * len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')), ['the', 'of', 'und'])), 0.9)) * (0.8 + (memory_id % 11) / 25.0)
  * exp(-0.05 * CASE memory_type WHEN 'semantic' THEN 0.7 WHEN 'procedural' THEN 0.45 WHEN 'exception' THEN 0.35 ELSE 1 END / least(4.0, greatest(1.0, 1 + 0.6 * ln(1 + reinforcement))) * (memory_id % 60))
  * (1 + CASE WHEN memory_id % 3 = 0 THEN 0.45 ELSE 0 END + CASE WHEN memory_type IN ('exception', 'procedural') THEN 0.3 ELSE 0 END + CASE WHEN workspace = 'en' THEN 0.2 ELSE 0 END + CASE WHEN memory_id % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN memory_id % 7 = 0 THEN 0.15 ELSE 0 END + CASE WHEN memory_type = 'exception' THEN 0.6 ELSE 0 END) AS s
  FROM memories m LEFT JOIN embeddings e ON e.vec_id = m.memory_id), n AS (SELECT memory_id, tenant, round(s::DOUBLE, 6) AS score FROM r) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY score DESC, memory_id) AS rank FROM n) WHERE rank <= 5""")
def l2_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-term memories for one question in one state of the agent: meaning, words, weight, age and fit."""
    i = F.col("memory_id")
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))  # the question: one row
    m = memories(spark, sf_dir).join(v.select(F.col("vec_id").alias("memory_id"), "embedding"), "memory_id", "left").crossJoin(F.broadcast(q))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    words = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("content"))), F.array(*[F.lit(w) for w in ("the", "of", "und")])))
    rows = {"hints": F.when(i % 3 == 0, F.array(F.lit("deploy"))).otherwise(F.array(F.lit("debug"))), "workspace": F.col("workspace"), "risk": F.when(i % 2 == 0, "high"), "stress": F.when(i % 7 == 0, "failure"), "type": F.col("memory_type"), "task": F.lit(None), "version": F.lit(None)}
    score = K.memory_score(dot, words, i % 11, S.l2_decay(F.col("memory_type"), S.durability(F.col("reinforcement")), i % 60), K.state_boost(rows, BOOSTED))
    return ranked(m.select("memory_id", "tenant", F.round(score, 6).alias("score")), "tenant", [F.desc("score"), "memory_id"], 5)


@query("retrieval_bundle", f"""WITH {MEMORIES_SQL}, s AS (SELECT tenant, part, id, score, sources FROM (SELECT tenant, 'rules' AS part, memory_id AS id, confidence AS score, memory_id % 3 AS sources FROM memories WHERE memory_type = 'policy' AND security_label <> 'restricted' UNION ALL SELECT tenant, 'episodes', memory_id, salience, 1 FROM memories WHERE memory_type = 'episodic' AND security_label <> 'restricted'
 UNION ALL SELECT tenant, 'procedures', memory_id, utility, 2 FROM memories WHERE memory_type = 'procedural' AND security_label <> 'restricted'))
SELECT tenant, part, id, score, rank, sources::INTEGER AS sources FROM (SELECT *, row_number() OVER (PARTITION BY tenant, part ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 4""")
def retrieval_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several stores side by side for each asker, behind one guard, with the number of sources each rests on."""
    m = memories(spark, sf_dir)
    some = lambda n: F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), n)
    part = lambda kind, score, n: m.where(F.col("memory_type") == kind).select("tenant", F.col("memory_id").alias("id"), F.col(score).alias("score"), some(n).alias("lineage"), "security_label")
    parts = {"rules": part("policy", "confidence", (F.col("memory_id") % 3).cast("int")), "episodes": part("episodic", "salience", F.lit(1)), "procedures": part("procedural", "utility", F.lit(2))}
    return K.bundle(parts, "tenant", 4, F.col("security_label") != "restricted")


@query("survivors", "SELECT event_id AS note_id, event_id % 7 AS nights, event_id AS seq FROM events WHERE event_type <> 'view' AND event_id % 7 > 3")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw notes that outlived their nights."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("note_id"), F.when(F.col("event_type") == "view", "compiled").otherwise("raw").alias("state"), (F.col("event_id") % 7).alias("nights"), F.col("event_id").alias("seq"))
    return K.survivors(e, 3)


@query("graph_bundle", "WITH e AS (SELECT user_id AS s, user_id * 7 % 50 AS t FROM events), b AS (SELECT DISTINCT s AS a, t AS b FROM (SELECT s, t FROM e UNION ALL SELECT t, s FROM e) WHERE s <> t) SELECT a AS source, CASE WHEN b % 3 = 0 THEN 'rule' WHEN b % 3 = 1 THEN 'episode' ELSE 'window' END AS node_type, count(*) AS n, min(b) AS first FROM b GROUP BY ALL")
def graph_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's neighbours by type."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.lit("r").alias("relation"), (F.col("user_id") * 7 % 50).alias("target"))
    nodes = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()
    kind = F.when(F.col("node") % 3 == 0, "rule").when(F.col("node") % 3 == 1, "episode").otherwise("window")
    return K.neighbourhood(e, nodes.withColumn("node_type", kind))


@query("metrics_store", "WITH m AS (SELECT event_type AS metric, user_id, value, event_id FROM events) SELECT metric, n, round(total, 4) AS total, last FROM (SELECT metric, count(*) AS n, sum(value) AS total, arg_max(event_id, event_id) AS last FROM m GROUP BY 1)")
def metrics_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics appended in two writes and read back: counts, sums and the latest entry of each."""
    from tidemark.sources.scratch import folder

    path = folder(spark, "metrics")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value", F.col("event_id").alias("seq"))
    for part in (0, 1):
        e.where(F.col("seq") % 2 == part).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("seq").alias("last"))


@query("dream_journal", "SELECT event_id AS report_id, user_id AS night FROM (SELECT * FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 20)")
def dream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reports of an appended journal, oldest of them first."""
    from tidemark.sources import stores
    from tidemark.sources.scratch import folder

    path = folder(spark, "journal")
    stores.write_jsonl(table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", "user_id", "ts"), path)
    rows = stores.read_jsonl(spark, path, "event_id long, user_id long, ts timestamp_ntz")
    return stores.tail(rows, 20, "ts", "event_id").select(F.col("event_id").alias("report_id"), F.col("user_id").alias("night"))
