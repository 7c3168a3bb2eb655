"""Queries of lifecycles, consolidation, routing and the remaining relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import text as T
from tidemark.operators import claims as C
from tidemark.operators import lifecycle as X
from tidemark.operators import retrieval as R
from tidemark.operators.sequences import trimmed
from tidemark.plans.registry import query
from tidemark.plans.retrieval import DT, QT
from tidemark.plans.temporal import SPANS_SQL
from tidemark.sources.adapters import CLAIMS_SQL, MEMORIES_SQL, claims, memories, table

q = lambda s: s.replace("'", "''")


@query("rule_lifecycle", f"""WITH RECURSIVE {CLAIMS_SQL}, s AS (SELECT subject AS rule, CASE kind WHEN 'repeat' THEN 'repeat' WHEN 'conflict' THEN 'challenge' WHEN 'correct' THEN 'govern' END AS kind, row_number() OVER (PARTITION BY subject ORDER BY event_id) AS i FROM claims WHERE kind IN ('repeat', 'conflict', 'correct')),
f AS (SELECT rule, 0::BIGINT AS i, 0.5::DOUBLE AS c, 0 AS n FROM (SELECT DISTINCT rule FROM s) UNION ALL SELECT s.rule, s.i, CASE s.kind WHEN 'repeat' THEN least(0.99, c + 0.08) WHEN 'challenge' THEN greatest(0.05, c - 0.15) ELSE greatest(0.68, c) + 0.03 END::DOUBLE, n + CASE WHEN s.kind = 'repeat' THEN 1 ELSE 0 END FROM f JOIN s ON s.rule = f.rule AND s.i = f.i + 1)
SELECT rule, round(c, 6) AS confidence, n AS repeats, CASE WHEN n >= 3 THEN 'stable' WHEN n >= 2 THEN 'reinforced' ELSE 'proposed' END AS state FROM f QUALIFY row_number() OVER (PARTITION BY rule ORDER BY i DESC) = 1""")
def rule_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "repeat", "repeat").when(F.col("kind") == "conflict", "challenge").when(F.col("kind") == "correct", "govern")
    s = claims(spark, sf_dir).select(F.col("subject").alias("rule"), kind.alias("kind"), F.col("event_id").alias("seq"), F.lit(0.5).alias("confidence")).where("kind is not null")
    return X.rule_states(s)


@query("reconstruct", f"""WITH {MEMORIES_SQL}, l AS (SELECT memory_id, contradiction, unnest([memory_id * 2, memory_id * 3, memory_id * 5 + 1]) AS event_id, unnest(['source', 'source', 'counter']) AS side FROM memories), d AS (SELECT memory_id, any_value(contradiction) AS contradiction, event_id, min(side) AS side FROM l GROUP BY ALL)
SELECT memory_id, event_id, side, ts, event_type, row_number() OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS position, contradiction > 0 OR EXISTS (SELECT 1 FROM d x WHERE x.memory_id = d.memory_id AND x.side = 'counter') AS conflict FROM d JOIN events USING (event_id)""")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of each memory's source and counter events, and whether anything speaks against it."""
    i = F.col("memory_id")
    pair = lambda e, s: F.struct(e.alias("event_id"), F.lit(s).alias("side"))
    m = memories(spark, sf_dir)
    links = m.select(i, "contradiction", F.explode(F.array(pair(i * 2, "source"), pair(i * 3, "source"), pair(i * 5 + 1, "counter"))).alias("x")).select("memory_id", "contradiction", "x.*")
    return X.reconstruction(links, table(spark, sf_dir, "events"))


@query("constitution_laws", f"""WITH {SPANS_SQL} SELECT 'no_overlap' AS law, (SELECT count(*) FROM (SELECT 1 FROM spans WHERE status = 'open' GROUP BY subject, predicate HAVING count(*) > 1)) AS violations UNION ALL SELECT 'window_order', count(*) FROM spans WHERE valid_to < valid_from
UNION ALL SELECT 'corrected_is_empty', count(*) FROM spans WHERE status = 'corrected' AND valid_to <> valid_from UNION ALL SELECT 'disputed_never_closes', count(*) FROM spans WHERE disputed AND valid_to IS NOT NULL
UNION ALL SELECT 'superseded_is_closed', count(*) FROM spans WHERE status = 'superseded' AND valid_to IS NULL UNION ALL SELECT 'confirmations_count', count(*) FROM spans WHERE confirmations < 0""")
def constitution_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.constitution(C.spans(claims(spark, sf_dir)))


@query("stated_date", r"""WITH t AS (SELECT conv_id, turn, text || CASE turn WHEN 1 THEN ' on 2024-03-05' WHEN 2 THEN ' at 7/11/2023' WHEN 3 THEN ' in 1999' ELSE '' END AS x FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(x, '\b\d{4}-\d{2}-\d{2}\b') THEN TRY_CAST(regexp_extract(x, '\b\d{4}-\d{2}-\d{2}\b') AS DATE)
 WHEN regexp_matches(x, '\b\d{1,2}/\d{1,2}/\d{4}\b') THEN CAST(try_strptime(regexp_extract(x, '\b\d{1,2}/\d{1,2}/\d{4}\b'), '%d/%m/%Y') AS DATE) WHEN regexp_matches(x, '\b(19|20)\d{2}\b') THEN make_date(CAST(regexp_extract(x, '\b(19|20)\d{2}\b') AS BIGINT), 1, 1) END AS stated FROM t""")
def stated_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") == 1, " on 2024-03-05").when(F.col("turn") == 2, " at 7/11/2023").when(F.col("turn") == 3, " in 1999").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.when_of(F.concat("text", said)).alias("stated"))


@query("question_route", f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{q(L.EVER)}', 'i') THEN 'ever' WHEN regexp_matches(text, '{q(L.TEMPORAL)}', 'i') THEN 'temporal' WHEN regexp_matches(text, '{q(L.SELF_HISTORY)}', 'i') THEN 'class' ELSE 'recall' END AS route FROM conversations")
def question_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.route(F.col("text")).alias("route"))


@query("unresolved_inference", "SELECT event_id, CASE WHEN event_type = 'error' THEN greatest(0.8, event_id % 10 / 10.0) ELSE event_id % 10 / 10.0 END::DOUBLE AS severity, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS unresolved FROM events")
def unresolved_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance = F.col("event_id") % 10 / 10.0
    bad = T.any_of(F.col("event_type"), ("fatal", "panic", "critical", "failed", "error"))
    return table(spark, sf_dir, "events").select("event_id", F.when(bad, F.greatest(F.lit(0.8), importance)).otherwise(importance).alias("severity"), F.when(bad, 1.0).otherwise(0.0).alias("unresolved"))


@query("identity_errors", "WITH m AS (SELECT user_id AS surface, event_type AS person, CAST(floor(value / 100) AS INTEGER) AS cluster FROM events), s AS (SELECT person, count(DISTINCT cluster) AS n FROM m GROUP BY 1), f AS (SELECT cluster, count(DISTINCT person) AS n FROM m GROUP BY 1) SELECT (SELECT round(avg((n > 1)::INTEGER), 6) FROM s) AS split_rate, (SELECT round(avg((n > 1)::INTEGER), 6) FROM f) AS false_merge_rate")
def identity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("person"), F.floor(F.col("value") / 100).cast("int").alias("cluster"))
    rate = lambda by, of: m.groupBy(by).agg(F.count_distinct(of).alias("n")).agg(F.round(F.avg((F.col("n") > 1).cast("int")), 6))
    return spark.range(1).select(rate("person", "cluster").scalar().alias("split_rate"), rate("cluster", "person").scalar().alias("false_merge_rate"))


@query("tick_time", "SELECT event_id, TIMESTAMP '2024-06-01 09:00:00' + INTERVAL 1 HOUR * (17 * (event_id % 1000)) AS at_time FROM events")
def tick_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.lit("2024-06-01 09:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(17 * (F.col("event_id") % 1000)).cast("int"))).alias("at_time"))


@query("share_blocks", "SELECT c.conv_id, b.role, count(*) AS shared FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn >= 1) c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 GROUP BY ALL")
def share_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    shares = c.where("turn >= 1").select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    return c.join(shares, ["conv_id", "turn"]).groupBy("conv_id", "role").agg(F.count("*").alias("shared"))


@query("vectors_of_candidates", "SELECT d.doc_id, e.label, len(e.embedding)::INTEGER AS dims FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.source = 'src5'")
def vectors_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source = 'src5'").select("doc_id")
    return d.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").select("doc_id", "label", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query("labels_of_events", "SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def labels_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("has"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(lab, "doc_id", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("has").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


@query("replay_pairs", f"WITH {MEMORIES_SQL}, r AS (SELECT memory_id, tenant, memory_type, row_number() OVER (PARTITION BY tenant, memory_type ORDER BY confidence DESC, memory_id) AS n FROM memories), t AS (SELECT * FROM r WHERE n <= 6) SELECT a.memory_id AS a, b.memory_id AS b FROM t a JOIN t b ON a.tenant = b.tenant AND a.memory_type = b.memory_type AND a.n < b.n WHERE (a.memory_id + b.memory_id) % 5 <> 0")
def replay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a group's best six that weren't processed before."""
    w = Window.partitionBy("tenant", "memory_type").orderBy(F.desc("confidence"), "memory_id")
    t = memories(spark, sf_dir).select("memory_id", "tenant", "memory_type", F.row_number().over(w).alias("n")).where("n <= 6")
    a, b = (t.select("tenant", "memory_type", F.col("memory_id").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    pairs = a.join(b, ["tenant", "memory_type"]).where("n_a < n_b").select("a", "b")
    done = pairs.where((F.col("a") + F.col("b")) % 5 == 0)
    return pairs.join(done, ["a", "b"], "left_anti")


@query("consolidated_containing", "WITH g AS (SELECT conv_id, list_sort(list(conv_id * 10 + turn)) AS sources FROM conversations GROUP BY 1) SELECT conv_id, len(sources)::INTEGER AS n FROM g WHERE list_has_any(sources, [11, 52, 133, 300])")
def consolidated_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("conv_id") * 10 + F.col("turn")).alias("sources"))
    return g.where(F.arrays_overlap("sources", F.array(*[F.lit(x).cast("long") for x in (11, 52, 133, 300)]))).select("conv_id", F.size("sources").alias("n"))


@query("focus_set", "WITH r AS (SELECT user_id, event_id, round(value, 6) AS attention FROM events WHERE event_type <> 'view') SELECT user_id, event_id, attention FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attention DESC, event_id) AS n FROM r) WHERE n <= 4")
def focus_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").select("user_id", "event_id", F.round("value", 6).alias("attention"))
    return trimmed(e, "user_id", 4, [F.desc("attention"), "event_id"])


@query("layer_rules", f"WITH {MEMORIES_SQL} SELECT memory_type AS layer, memory_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY confidence DESC, memory_id) AS n FROM memories WHERE confidence >= CASE WHEN memory_type = 'policy' THEN 0.8 ELSE 0.6 END) WHERE n <= 4")
def layer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).where(F.col("confidence") >= F.when(F.col("memory_type") == "policy", 0.8).otherwise(0.6))
    return trimmed(m.select(F.col("memory_type").alias("layer"), "memory_id", "confidence"), "layer", 4, [F.desc("confidence"), "memory_id"])


@query("set_algebra", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 150) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a, b = e.where("event_type = 'error'").select("user_id").distinct(), e.where("event_type = 'purchase' and value > 150").select("user_id").distinct()
    n = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.exceptAll(b), "only_a")).unionByName(n(a.union(b).distinct(), "any"))


@query("coverage_retrieve", "WITH n AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, round(((conv_id % 10) / 9.0 * (0.2 + 0.8 * exp(-last / (1.0 + n))))::DOUBLE, 6) AS score FROM n ORDER BY score DESC, conv_id LIMIT 15")
def coverage_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance weakened by what a summary has lost since it was last reinforced."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    retention = F.exp(-F.col("last") / (1.0 + F.col("n")))
    return n.select("conv_id", F.round(F.col("conv_id") % 10 / 9.0 * (0.2 + 0.8 * retention), 6).alias("score")).orderBy(F.desc("score"), "conv_id").limit(15)


@query("approval_queue", f"WITH {CLAIMS_SQL} SELECT subject AS request, arg_max(CASE WHEN k % 3 = 0 THEN 'approved' WHEN k % 3 = 1 THEN 'denied' ELSE 'pending' END, event_id) AS status, count(*) AS entries FROM claims WHERE predicate = 'signup' GROUP BY 1")
def approval_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and their latest resolution, from an append-only queue."""
    s = F.when(F.col("k") % 3 == 0, "approved").when(F.col("k") % 3 == 1, "denied").otherwise("pending")
    return claims(spark, sf_dir).where("predicate = 'signup'").groupBy(F.col("subject").alias("request")).agg(F.max_by(s, "event_id").alias("status"), F.count("*").alias("entries"))


@query("quarantine_log", f"WITH {CLAIMS_SQL} SELECT 'r' || (k % 4) AS runtime, CAST(1 + k % 2 AS INTEGER) AS version, count(*) AS n, min(observed_at) AS first_at, max(observed_at) AS last_at FROM claims WHERE kind = 'conflict' GROUP BY ALL")
def quarantine_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).where("kind = 'conflict'")
    return c.groupBy(F.concat(F.lit("r"), (F.col("k") % 4).cast("string")).alias("runtime"), (1 + F.col("k") % 2).cast("int").alias("version")).agg(F.count("*").alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


@query("agent_checkpoint", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def agent_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.audit import latest

    return latest(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role")


@query("safe_envelope", "WITH r AS (SELECT time_bucket(INTERVAL '1 day', ts) AS d, count(*) AS n FROM events GROUP BY 1), m AS (SELECT min(n) AS floor FROM r) SELECT CAST(floor(0.7 * floor) AS BIGINT) AS safe, floor AS burst, 2 * floor AS queue FROM m")
def safe_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("m")).select(F.floor(0.7 * F.col("m")).alias("safe"), F.col("m").alias("burst"), (2 * F.col("m")).alias("queue"))


@query("context_metrics", "WITH t AS (SELECT conv_id, sum(greatest(1, (strlen(text) + 3) // 4))::BIGINT AS naive, max(greatest(1, (strlen(text) + 3) // 4))::BIGINT AS packed, conv_id % 3 = 0 AS hit FROM conversations GROUP BY conv_id) SELECT count(*) AS packets, round(avg(hit::INTEGER), 6) AS hit_rate, round(1 - sum(packed) / sum(naive)::DOUBLE, 6) AS reduction, quantile_disc(packed, 0.5) AS p50, quantile_disc(packed, 0.95) AS p95 FROM t")
def context_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.token_estimate(F.col("text"))
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).alias("naive"), F.max(n).alias("packed")).withColumn("hit", (F.col("conv_id") % 3 == 0).cast("int"))
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY packed)").cast("bigint")
    return t.agg(F.count("*").alias("packets"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(1 - F.sum("packed") / F.sum("naive"), 6).alias("reduction"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("world_relation_cases", f"WITH {CLAIMS_SQL}, p AS (SELECT subject, predicate, event_id, bucket, lag(bucket) OVER w AS old, kind, count(*) OVER (PARTITION BY subject, predicate ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM claims WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, event_id)) SELECT kind, old IS NULL AS opens, coalesce(old = bucket, false) AS same, count(*) AS n, max(nth) AS deepest FROM p GROUP BY ALL")
def world_relation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("subject", "predicate").orderBy("observed_at", "event_id")
    p = claims(spark, sf_dir).select("kind", "bucket", F.lag("bucket").over(w).alias("old"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"))
    return p.groupBy("kind", F.col("old").isNull().alias("opens"), F.coalesce(F.col("old") == F.col("bucket"), F.lit(False)).alias("same")).agg(F.count("*").alias("n"), F.max("nth").alias("deepest"))


@query("ingest_class", "SELECT doc_id, CASE WHEN contains(lower(text), 'error') OR contains(lower(text), 'mistake') THEN 'mistake' WHEN contains(lower(text), 'score') THEN 'score' WHEN contains(lower(text), 'the ') THEN 'lesson_fact' ELSE 'progress' END AS class FROM documents")
def ingest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(T.any_of(t, ("error", "mistake")), "mistake").when(T.any_of(t, ("score",)), "score").when(T.any_of(t, ("the ",)), "lesson_fact").otherwise("progress").alias("class"))


@query("belief_timeline", f"WITH {SPANS_SQL} SELECT subject, predicate, row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from, observed_at, event_id) AS position, event_id, valid_from, valid_to FROM spans WHERE NOT disputed")
def belief_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", "observed_at", "event_id")
    return C.spans(claims(spark, sf_dir)).where(~F.col("disputed")).select("subject", "predicate", F.row_number().over(w).cast("bigint").alias("position"), "event_id", "valid_from", "valid_to")
