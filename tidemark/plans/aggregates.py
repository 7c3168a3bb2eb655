"""Queries of aggregates, windows, graphs and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import graph as G
from tidemark.operators import metrics as M
from tidemark.operators import overlaps as O
from tidemark.operators import sequences as Q
from tidemark.operators.quantiles import nearest_rank_time
from tidemark.plans.registry import query
from tidemark.sources.adapters import CLAIMS_SQL, MEMORIES_SQL, claims, memories, table


@query("wilson_capability", f"""WITH {CLAIMS_SQL}, g AS (SELECT subject, predicate, count(*) FILTER (k % 3 <> 0) AS successes, count(*) AS n FROM claims GROUP BY ALL), w AS (SELECT *, successes / n::DOUBLE AS p FROM g),
l AS (SELECT *, round(greatest(0.0, (p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))::DOUBLE, 6) AS lower FROM w) SELECT subject, predicate, successes, n, round(p, 6) AS rate, lower, n < 3 OR lower < 0.55 AS delegate FROM l""")
def wilson_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.capability(claims(spark, sf_dir).withColumn("success", F.col("k") % 3 != 0), ["subject", "predicate"])


@query("causal_confidence", f"""WITH {CLAIMS_SQL}, g AS (SELECT predicate AS cause, bucket AS effect, count(*) FILTER (kind <> 'conflict') AS support, count(*) FILTER (kind = 'conflict') AS counter, count(*) FILTER (k % 25 = 0) AS iv FROM claims GROUP BY ALL),
c AS (SELECT *, round(least(0.99, (support + 1) / (support + counter + 2)::DOUBLE + least(0.04 * iv, 0.16))::DOUBLE, 6) AS confidence FROM g) SELECT cause, effect, support, counter, confidence FROM c WHERE confidence >= 0.55""")
def causal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = claims(spark, sf_dir).groupBy(F.col("predicate").alias("cause"), F.col("bucket").alias("effect")).agg(F.count_if(F.col("kind") != "conflict").alias("support"), F.count_if(F.col("kind") == "conflict").alias("counter"), F.count_if(F.col("k") % 25 == 0).alias("iv"))
    return g.withColumn("confidence", F.round(S.causal_confidence(F.col("support"), F.col("counter"), F.col("iv")), 6)).where("confidence >= 0.55").drop("iv")


@query("counterfactual", f"""WITH {CLAIMS_SQL}, g AS (SELECT predicate AS cause, bucket AS effect, (count(*) FILTER (kind <> 'conflict') + 1) / (count(*) + 2)::DOUBLE AS c FROM claims GROUP BY ALL) SELECT effect, count(*) AS causes, round(min(c), 6) AS overall FROM g WHERE cause IN ('click', 'error') GROUP BY effect""")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of the enabled causes; a chain is as sure as its least sure link."""
    g = claims(spark, sf_dir).groupBy(F.col("predicate").alias("cause"), F.col("bucket").alias("effect")).agg(((F.count_if(F.col("kind") != "conflict") + 1) / (F.count("*") + 2)).alias("c"))
    return g.where(F.col("cause").isin("click", "error")).groupBy("effect").agg(F.count("*").alias("causes"), F.round(F.min("c"), 6).alias("overall"))


_TRACES = f"{CLAIMS_SQL}, tr AS (SELECT 'g' || (subject % 40) AS goal, 's' || (k % 4) AS steps, k % 6 <> 0 AS success FROM claims)"


@query("procedure_mining", f"""WITH {_TRACES}, ok AS (SELECT goal, steps, count(*) AS support FROM tr WHERE success GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY support DESC, steps) AS n FROM ok) WHERE n = 1 AND support >= 2),
t AS (SELECT goal, count(*) FILTER (success) AS s, count(*) FILTER (NOT success) AS f FROM tr GROUP BY 1) SELECT goal, steps, support, round(least(0.95, 0.55 + 0.10 * s - 0.30 * f)::DOUBLE, 6) AS confidence, s >= 4 AS stable FROM b JOIN t USING (goal) WHERE s >= 2 AND f / (s + f)::DOUBLE <= 0.25""")
def procedure_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    tr = claims(spark, sf_dir).select(name("g", F.col("subject") % 40).alias("goal"), name("s", F.col("k") % 4).alias("steps"), (F.col("k") % 6 != 0).alias("success"))
    return M.procedures(tr)


@query("evidence_assess", f"""WITH l AS (SELECT user_id AS claim, event_id, CASE WHEN event_id % 4 = 0 THEN 'counter' ELSE 'support' END AS side, CAST(event_id % 6 AS INTEGER) AS tier, event_type AS source FROM events),
g AS (SELECT claim, sum(CASE WHEN side = 'support' THEN tier + 1 ELSE 0 END)::BIGINT AS pro, sum(CASE WHEN side = 'counter' THEN tier + 1 ELSE 0 END)::BIGINT AS con, count(DISTINCT source) FILTER (side = 'support') AS sources FROM l GROUP BY 1)
SELECT claim, round(pro / (pro + con)::DOUBLE, 6) AS ratio, sources, round(least(1.0, greatest(0.0, 0.15 + 0.4 * (pro / (pro + con)::DOUBLE) + least(0.24, 0.08 * greatest(0, sources - 1))))::DOUBLE, 6) AS score FROM g""")
def evidence_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    links = e.select(F.col("user_id").alias("claim"), "event_id", F.when(F.col("event_id") % 4 == 0, "counter").otherwise("support").alias("side"))
    return M.evidence(links, e.select("event_id", (F.col("event_id") % 6).cast("int").alias("tier"), F.col("event_type").alias("source")), "claim")


@query("conflict_clusters", """WITH f AS (SELECT user_id, event_type AS kind, CAST(floor(value / 50) AS INTEGER) AS v, round((count(*) * 0.22 + max(value) / 1000)::DOUBLE, 6) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY score DESC, v) AS n, count(*) OVER (PARTITION BY user_id, kind) AS distinct_values FROM f)
SELECT user_id, kind, any_value(distinct_values) AS distinct_values, max(v) FILTER (n = 1) AS leader, string_agg(v::VARCHAR, ',' ORDER BY n) FILTER (n <= 4) AS top FROM r WHERE distinct_values >= 2 GROUP BY user_id, kind""")
def conflict_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with several values: the leader and the best four."""
    f = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("kind"), F.floor(F.col("value") / 50).cast("int").alias("v")).agg(F.round(F.count("*") * 0.22 + F.max("value") / 1000, 6).alias("score"))
    top = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "v")))
    g = f.groupBy("user_id", "kind").agg(F.count("*").alias("distinct_values"), top.alias("line")).where("distinct_values >= 2")
    return g.select("user_id", "kind", "distinct_values", F.element_at("line", 1)["v"].alias("leader"), F.array_join(F.transform(F.slice("line", 1, 4), lambda x: x["v"].cast("string")), ",").alias("top"))


@query("confidence_dashboard", f"""WITH {MEMORIES_SQL}, s AS (SELECT memory_type, round(least(1.0, (memory_id % 10) / 10.0 * exp(-0.05 * CASE memory_type WHEN 'semantic' THEN 0.7 WHEN 'procedural' THEN 0.45 WHEN 'exception' THEN 0.35 ELSE 1 END * (memory_id % 40)) * 1.15)::DOUBLE, 6) AS c FROM memories)
SELECT memory_type, count(*) AS n, round(avg(c), 6) AS confidence, count(*) FILTER (c < 0.4) AS stale FROM s GROUP BY 1""")
def confidence_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("memory_id")
    c = F.round(F.least(F.lit(1.0), i % 10 / 10.0 * S.l2_decay(F.col("memory_type"), F.lit(1.0), i % 40) * 1.15), 6)
    return memories(spark, sf_dir).select("memory_type", c.alias("c")).groupBy("memory_type").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("confidence"), F.count_if(F.col("c") < 0.4).alias("stale"))


@query("exact_dashboard", "WITH f AS (SELECT event_type AS kind, user_id, count(*) AS r, count(DISTINCT CAST(floor(value / 50) AS INTEGER)) AS v FROM events GROUP BY ALL) SELECT kind, count(*) AS facts, count(*) FILTER (v > 5) AS conflicting, round(avg(0.7 * 0.5 + 0.25 * 0.82 + 0.03 * least(r, 6))::DOUBLE, 6) AS confidence FROM f GROUP BY 1")
def exact_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), "user_id").agg(F.count("*").alias("r"), F.count_distinct(F.floor(F.col("value") / 50)).alias("v"))
    return f.groupBy("kind").agg(F.count("*").alias("facts"), F.count_if(F.col("v") > 5).alias("conflicting"), F.round(F.avg(0.7 * 0.5 + 0.25 * 0.82 + 0.03 * F.least("r", F.lit(6))), 6).alias("confidence"))


@query("scope_report", "SELECT source AS tenant, lang AS workspace, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL")
def scope_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("tenant"), F.col("lang").alias("workspace")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("failure_matrix_cube", "SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, CASE WHEN GROUPING(severity) = 1 THEN '*' ELSE severity END AS severity, count(*) AS n FROM (SELECT source, lang, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'none' END AS severity FROM documents JOIN labels USING (doc_id)) GROUP BY CUBE (source, lang, severity)")
def failure_matrix_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "low").otherwise("none")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "lang", sev.alias("severity"))
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return d.cube("source", "lang", "severity").agg(F.count("*").alias("n")).select(star("source"), star("lang"), star("severity"), "n")


@query("failure_matrix_rollup", "SELECT coalesce(event_type, '*') AS event_type, coalesce(b, -1) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT event_type, user_id, CAST(floor(value / 100) AS INTEGER) AS b FROM events) GROUP BY ROLLUP (event_type, b)")
def failure_matrix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.floor(F.col("value") / 100).cast("int").alias("b"))
    return e.rollup("event_type", "b").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.coalesce("event_type", F.lit("*")).alias("event_type"), F.coalesce("b", F.lit(-1)).alias("bucket"), "n", "users")


@query("percentiles", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, round(v[greatest(1, CAST(ceil(0.95 * len(v)) AS INTEGER))], 6) AS nearest_rank, round(v[least(CAST(floor(len(v) * 0.99) AS INTEGER), len(v) - 1) + 1], 6) AS index_rank, round(v[CAST(ceil((len(v) - 1) * 0.95) AS INTEGER) + 1], 6) AS upper_rank, round((v[CAST(floor((len(v) - 1) / 2) AS INTEGER) + 1] + v[CAST(ceil((len(v) - 1) / 2) AS INTEGER) + 1]) / 2, 6) AS median FROM s")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four definitions in use: nearest rank, int(n q), the upper neighbour of (n-1) q, and the median."""
    v = F.col("v")
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sort_array(F.collect_list("value")).alias("v"), M.nearest_rank(0.95, "value").alias("nearest_rank"), F.percentile("value", 0.5).alias("median"))
    upper = F.element_at(v, F.ceil((F.size(v) - 1) * 0.95).cast("int") + 1)
    return s.select("event_type", F.round("nearest_rank", 6).alias("nearest_rank"), F.round(M.index_percentile(v, 0.99), 6).alias("index_rank"), F.round(upper, 6).alias("upper_rank"), F.round("median", 6).alias("median"))


@query("histogram_merge", """WITH h AS (SELECT event_type, CAST(floor(log10(greatest(value, 1e-9)) * 50) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, min(bucket) AS bucket, round((10.0 ** ((min(bucket) + 1) / 50.0))::DOUBLE, 6) AS value FROM r WHERE run >= ceil(0.95 * total) GROUP BY 1""")
def histogram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p95 of two partial histograms, merged."""
    e = table(spark, sf_dir, "events")
    parts = [M.histogram(e.where(c), ["event_type"], "value") for c in ("event_id % 2 = 0", "event_id % 2 = 1")]
    merged = parts[0].unionByName(parts[1]).groupBy("event_type", "bucket").agg(F.sum("n").alias("n"))
    return M.histogram_percentile(merged, ["event_type"], 0.95)


@query("slo_eval", """WITH m(metric, value) AS (SELECT 'events', count(*)::DOUBLE FROM events UNION ALL SELECT 'p95_value', quantile_disc(value, 0.95) FROM events UNION ALL SELECT 'users', count(DISTINCT user_id)::DOUBLE FROM events), r(metric, op, wanted) AS (VALUES ('events', 'gte', 5000.0), ('p95_value', 'lte', 10.0), ('users', 'gte', 100.0), ('soak_hours', 'gte', 1.0))
SELECT r.metric, r.wanted::DOUBLE AS wanted, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'not_measured' WHEN CASE op WHEN 'lte' THEN value <= wanted ELSE value >= wanted END THEN 'pass' ELSE 'fail' END AS verdict FROM r LEFT JOIN m ON m.metric = r.metric""")
def slo_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").agg(F.count("*").cast("double").alias("events"), M.nearest_rank(0.95, "value").alias("p95_value"), F.count_distinct("user_id").cast("double").alias("users"))
    measured = e.unpivot([], ["events", "p95_value", "users"], "metric", "value")
    rules = spark.createDataFrame([("events", "gte", 5000.0), ("p95_value", "lte", 10.0), ("users", "gte", 100.0), ("soak_hours", "gte", 1.0)], "metric string, op string, wanted double")
    return M.objectives(measured, rules)


_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("token_f1", f"""WITH p AS (SELECT conv_id, turn, {_W} AS want, lead({_W}) OVER (PARTITION BY conv_id ORDER BY turn) AS got FROM conversations), k AS (SELECT * FROM p WHERE got IS NOT NULL),
c AS (SELECT a.conv_id, a.turn, sum(least(a.x, b.y)) AS common FROM (SELECT conv_id, turn, t, count(*) AS x FROM (SELECT conv_id, turn, unnest(want) AS t FROM k) GROUP BY ALL) a JOIN (SELECT conv_id, turn, t, count(*) AS y FROM (SELECT conv_id, turn, unnest(got) AS t FROM k) GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t GROUP BY 1, 2)
SELECT k.conv_id, k.turn, round(CASE WHEN coalesce(common, 0) = 0 THEN 0 ELSE 2 * (common / len(got)::DOUBLE) * (common / len(want)::DOUBLE) / (common / len(got)::DOUBLE + common / len(want)::DOUBLE) END, 6) AS f1, want = got AS exact FROM k LEFT JOIN c USING (conv_id, turn)""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("want")).withColumn("got", F.lead("want").over(w)).where("got is not null")
    return M.token_f1(p, ["conv_id", "turn"])


@query("rank_metrics", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label = e.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) AS rank FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
f AS (SELECT query_id, min(rank) FILTER (hit) AS first FROM s GROUP BY 1) SELECT count(*) AS queries, round(avg((first <= 1)::INTEGER), 6) AS recall_1, round(avg((first <= 5)::INTEGER), 6) AS recall_5, round(avg((first <= 10)::INTEGER), 6) AS recall_10, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END)::DOUBLE, 6) AS mrr_10 FROM f""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.matching import vector_topk

    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0")
    top = vector_topk(e.select("vec_id", "embedding"), q.select("vec_id", "embedding"), 10)
    hits = top.join(e.select("vec_id", F.col("label").alias("a")), "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("b")), "query_id").where("a = b").groupBy("query_id").agg(F.min("rank").alias("first"))
    f = q.select(F.col("vec_id").alias("query_id")).join(hits, "query_id", "left")
    share = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"recall_{k}")
    return f.agg(F.count("*").alias("queries"), share(1), share(5), share(10), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr_10"))


@query("scorecard", f"WITH {CLAIMS_SQL} SELECT predicate AS family, count(*) AS asked, count(*) FILTER (k % 5 <> 0) AS correct, round(count(*) FILTER (k % 5 <> 0) / count(*)::DOUBLE, 6) AS accuracy, count(*) FILTER (k % 50 = 0) AS leaks FROM claims GROUP BY 1")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    return c.groupBy(F.col("predicate").alias("family")).agg(F.count("*").alias("asked"), F.count_if(F.col("k") % 5 != 0).alias("correct"), F.round(F.count_if(F.col("k") % 5 != 0) / F.count("*"), 6).alias("accuracy"), F.count_if(F.col("k") % 50 == 0).alias("leaks"))


@query("canary_drift", """WITH p AS (SELECT event_type, epoch_us(ts) / 1e6 AS x, value FROM events), m AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM p WINDOW w AS (PARTITION BY event_type)), g AS (SELECT *, least(3600.0, (hi - lo) / 3) AS w FROM m),
a AS (SELECT event_type, count(*) AS n, round(avg(value) FILTER (x <= lo + w), 6) AS first, round(avg(value) FILTER (x >= hi - w), 6) AS last, max(hi - lo) AS span FROM g GROUP BY 1) SELECT event_type, n, first, last, round(last - first, 6) AS drift, round(round(last - first, 6) * 3600 / span, 6) AS per_hour FROM a WHERE n >= 4""")
def canary_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").cast("double").alias("elapsed"), "value")
    return M.drift(e, ["event_type"])


@query("health_snapshot", f"WITH {MEMORIES_SQL} SELECT tenant, count(*) AS n, count(*) FILTER (lifecycle_state IN ('stable', 'reinforced')) AS settled, count(*) FILTER (lifecycle_state = 'challenged') AS challenged, round(avg(confidence) FILTER (lifecycle_state <> 'archived'), 6) AS confidence FROM memories GROUP BY 1")
def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("lifecycle_state")
    return memories(spark, sf_dir).groupBy("tenant").agg(F.count("*").alias("n"), F.count_if(s.isin("stable", "reinforced")).alias("settled"), F.count_if(s == "challenged").alias("challenged"), F.round(F.avg(F.when(s != "archived", F.col("confidence"))), 6).alias("confidence"))


@query("belief_summary", "SELECT c_mktsegment AS segment, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'P') AS pending FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def belief_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge counts by relation, pivoted."""
    j = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")).join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), "c_custkey")
    p = j.groupBy("segment").pivot("o_orderstatus", ["O", "F", "P"]).count()
    return p.select("segment", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("O", "open"), ("F", "filled"), ("P", "pending"))])


@query("distinct_users", "SELECT event_type, count(DISTINCT coalesce(user_id, -1)) AS users, count(DISTINCT (user_id, CAST(floor(value / 50) AS INTEGER))) AS pairs FROM events GROUP BY 1")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct(F.coalesce("user_id", F.lit(-1))).alias("users"), F.count_distinct("user_id", F.floor(F.col("value") / 50)).alias("pairs"))


_L1 = "l1 AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS unresolved, least(1.0, value / 250)::DOUBLE AS severity FROM events)"


@query("homeostasis", f"""WITH {_L1}, n AS (SELECT *, row_number() OVER w AS i, unresolved >= 0.5 OR severity >= 0.75 AS failed, avg(unresolved) OVER f AS u, avg(severity) OVER f AS s FROM l1 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, least(i - coalesce(max(CASE WHEN NOT failed THEN i END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 12)::INTEGER AS streak FROM n), t AS (SELECT *, round(least(1.0, greatest(0.0, 0.45 * u + 0.35 * s + 0.2 * least(streak / 5.0, 1.0)))::DOUBLE + 1e-9, 6) AS stress FROM k),
r AS (SELECT *, 0.15 + 0.2 * stress + 0.2 + 0.1 * stress + greatest(0.05, 0.15 - 0.05 * stress) + greatest(0.1, 0.2 - 0.05 * stress) AS rest FROM t) SELECT user_id, ts, event_id, streak, stress, round(1 + stress, 3) AS gain, round((greatest(0.15, 1 - rest) / (greatest(0.15, 1 - rest) + rest))::DOUBLE, 6) AS task_weight FROM r""")
def homeostasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("unresolved"), F.least(F.lit(1.0), F.col("value") / 250).alias("severity"))
    return Q.homeostasis(e, "user_id", ["ts", "event_id"])


@query("novelty", "WITH e AS (SELECT user_id, ts, event_id, event_type AS source, CAST(floor(value / 50) AS INTEGER) AS topic FROM events), w AS (SELECT *, list({'s': source, 't': topic}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS seen FROM e) SELECT user_id, ts, event_id, round(greatest(0.0, 0.9 - 0.2 * coalesce(len(list_filter(seen, lambda x: x.s = source AND x.t = topic)), 0))::DOUBLE, 6) AS novelty FROM w")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("source"), F.floor(F.col("value") / 50).cast("int").alias("topic"))
    return Q.novelty(e, "user_id", ["ts", "event_id"])


@query("overflow_trim", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 8")
def overflow_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.trimmed(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", 8, [F.desc("value"), "event_id"])


@query("coverage_leaves", "WITH r AS (SELECT *, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 6 AS leaf FROM conversations) SELECT role, leaf::BIGINT AS leaf, count(*) AS n, md5(left(string_agg(left(text, 140), ' · ' ORDER BY conv_id, turn), 900)) AS summary_md5 FROM r GROUP BY ALL")
def coverage_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = Q.coverage_leaves(table(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))), lambda x: x["text"])
    return leaves.groupBy("role", "leaf").agg(F.count("*").alias("n"), F.md5(T.extractive_summary(parts).cast("binary")).alias("summary_md5"))


@query("coverage_levels", "WITH l AS (SELECT role, leaf, count(*) AS n FROM (SELECT role, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 6 AS leaf FROM conversations) GROUP BY ALL), a AS (SELECT role, 0 AS level, leaf AS node, n FROM l), b AS (SELECT role, 1 AS level, node // 6 AS node, sum(n) AS n FROM a GROUP BY ALL), c AS (SELECT role, 2 AS level, node // 6 AS node, sum(n) AS n FROM b GROUP BY ALL) SELECT role, level::INTEGER AS level, node::BIGINT AS node, n::BIGINT AS n FROM (FROM a UNION ALL FROM b UNION ALL FROM c)")
def coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = Q.coverage_leaves(table(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"]).groupBy("role", "leaf").agg(F.count("*").alias("n"))
    return Q.coverage_levels(leaves, "role", 2)


@query("coverage_report", "WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE turn >= 2) SELECT count(DISTINCT a.conv_id) AS episodes, count(DISTINCT c.conv_id) AS covered, count(DISTINCT a.conv_id) - count(DISTINCT c.conv_id) AS orphans FROM conversations a LEFT JOIN c ON c.conv_id = a.conv_id")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many episodes a summary covers, and how many none does."""
    c = table(spark, sf_dir, "conversations")
    every, covered = c.select("conv_id").distinct(), c.where("turn >= 2").select("conv_id", F.lit(1).alias("has")).distinct()
    return every.join(covered, "conv_id", "left").agg(F.count("*").alias("episodes"), F.count("has").alias("covered"), F.count_if(F.col("has").isNull()).alias("orphans"))


EDGES = "edges AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda t, a, p, b, q: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("source"), F.concat(F.lit(q), F.col(b).cast("string")).alias("target"))
    return pair("nation", "n_nationkey", "n", "n_regionkey", "r").unionByName(pair("customer", "c_custkey", "c", "c_nationkey", "n")).unionByName(pair("supplier", "s_suppkey", "s", "s_nationkey", "n"))


@query("graph_neighbours", f"WITH {EDGES}, u AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges) SELECT source, count(*) AS degree, min(target) AS least, max(target) AS most FROM u WHERE source <> target GROUP BY 1")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(_edges(spark, sf_dir))


@query("graph_paths", f"WITH RECURSIVE {EDGES}, u AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), w AS (SELECT 'r0' AS node, 0 AS hops UNION SELECT u.target, w.hops + 1 FROM w JOIN u ON u.source = w.node WHERE w.hops < 3) SELECT node, min(hops)::INTEGER AS hops FROM w GROUP BY 1")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distances(_edges(spark, sf_dir), "r0")


@query("graph_upsert", "SELECT 'n' || n_nationkey AS node_key, CASE WHEN n_nationkey % 2 = 0 THEN 'country' ELSE 'nation' END AS node_type, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'yes' END AS checked FROM nation")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_key")
    old = n.select(key, F.lit("nation").alias("node_type"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("checked"), F.lit(None).cast("string")).alias("properties"), F.lit(1).alias("seq"))
    new = n.where("n_nationkey % 2 = 0").select(key, F.lit("country").alias("node_type"), F.create_map(F.lit("checked"), F.lit("yes")).alias("properties"), F.lit(2).alias("seq"))
    return G.upsert(old, new).select("node_key", "node_type", F.col("properties")["name"].alias("name"), F.col("properties")["checked"].alias("checked"))


@query("graph_delete", f"WITH {EDGES}, d AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey % 3 = 0) SELECT source, target FROM edges WHERE source NOT IN (SELECT node FROM d) AND target NOT IN (SELECT node FROM d)")
def graph_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return G.without_nodes(_edges(spark, sf_dir), gone)


@query("lineage", "SELECT c_nationkey AS belief, count(DISTINCT o_orderkey) AS episodes, count(DISTINCT l_suppkey) AS sources FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs to their evidence through two hops, without repeats."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    j = li.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", F.col("c_nationkey").alias("belief")), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("belief").agg(F.count_distinct("o_orderkey").alias("episodes"), F.count_distinct("l_suppkey").alias("sources"))


@query("soak_windows", "WITH m AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS minute, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS windows, round(min(p95), 6) AS best, round(max(p95), 6) AS worst, sum(n)::BIGINT AS events FROM m")
def soak_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours")).agg(M.nearest_rank(0.95, "value").alias("p95"), F.count("*").alias("n"))
    return m.agg(F.count("*").alias("windows"), F.round(F.min("p95"), 6).alias("best"), F.round(F.max("p95"), 6).alias("worst"), F.sum("n").alias("events"))


@query("session_windows", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '12 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), n AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("split_proposal", "SELECT CASE WHEN ts < (SELECT quantile_disc(ts, 0.8) FROM events) THEN 'train' WHEN ts < (SELECT quantile_disc(ts, 0.9) FROM events) THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM events GROUP BY 1")
def split_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts")
    cut = lambda x: nearest_rank_time(e, "ts", x)
    return e.groupBy(F.when(F.col("ts") < cut(0.8), "train").when(F.col("ts") < cut(0.9), "validation").otherwise("test").alias("part")).agg(F.count("*").alias("n"))


@query("subject_identity", "WITH k AS (SELECT lower(n_name) AS name FROM nation), s AS (SELECT DISTINCT right(lower(n_name), 3) AS surface FROM nation) SELECT surface, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(name) END AS subject FROM s JOIN k ON ends_with(name, surface) GROUP BY 1")
def subject_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface form stands for the one known subject it completes; several mean that nobody knows. Joined on the last letters, then tested."""
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).withColumn("tail", F.right("name", F.lit(3)))
    s = n.select(F.col("tail").alias("surface"), "tail").distinct()
    return s.join(n, "tail").where(F.col("name").endswith(F.col("surface"))).groupBy("surface").agg(F.count("*").alias("matches"), F.when(F.count("*") == 1, F.min("name")).alias("subject"))


@query("runtime_sessions", "WITH s AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY 1) SELECT user_id, beat, (SELECT max(ts) FROM events) - beat > INTERVAL '1 hour' AS stale FROM s")
def runtime_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max("ts").alias("beat")).withColumn("stale", e.agg(F.max("ts")).scalar() - F.col("beat") > F.expr("INTERVAL 1 HOUR"))


@query("rule_conflicts", f"""WITH {MEMORIES_SQL}, t AS (SELECT memory_id, tenant, (memory_id // 60) % 2 AS polarity, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM memories WHERE memory_type = 'policy')
SELECT a.memory_id AS a, b.memory_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS overlap FROM t a JOIN t b ON a.tenant = b.tenant AND a.polarity <> b.polarity AND a.memory_id < b.memory_id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.03""")
def rule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one scope with opposite polarity and much the same words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    t = memories(spark, sf_dir).where("memory_type = 'policy'").select("memory_id", "tenant", (F.floor(F.col("memory_id") / 60) % 2).alias("polarity"), words.alias("w"))
    side = lambda p: t.where(F.col("polarity") == p).select("tenant", F.col("memory_id").alias("id"), "w")
    j = O.overlapping(side(0), side(1), "tenant", 0.03)
    return j.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), F.round("overlap", 6).alias("overlap"))
