"""Queries of audits, deletion and the projection queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators import audit as A
from tidemark.plans.registry import query
from tidemark.sources.adapters import CLAIMS_SQL, LEDGER_SQL, MEMORIES_SQL, OUTBOX_SQL, claims, ledger, memories, outbox, table

NOW = 1_800_000_000.0


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log without every 40th event, the outbox and the ledger."""
    return table(spark, sf_dir, "events").where("event_id % 40 <> 0"), outbox(spark, sf_dir), ledger(spark, sf_dir)


LOG_SQL = LEDGER_SQL + ", log AS (SELECT event_id, user_id FROM events WHERE event_id % 40 <> 0)"
FIND_SQL = LOG_SQL + f""", f AS (
 SELECT 'outbox_without_event' AS code, 'error' AS severity, job_id AS key FROM outbox o WHERE NOT EXISTS (SELECT 1 FROM log e WHERE e.event_id = o.event_id)
 UNION ALL SELECT 'completed_without_projection', 'error', job_id FROM outbox o WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.event_id = o.event_id AND l.projection_type = o.projection_type)
 UNION ALL SELECT 'skipped_with_ledger', 'warning', job_id FROM outbox o WHERE status = 'skipped' AND EXISTS (SELECT 1 FROM ledger l WHERE l.event_id = o.event_id AND l.projection_type = o.projection_type)
 UNION ALL SELECT 'ledger_tenant_mismatch', 'critical', target_id FROM ledger l JOIN outbox o USING (event_id, projection_type) WHERE l.tenant <> o.tenant
 UNION ALL SELECT 'projected_without_debt', 'warning', event_id::VARCHAR FROM log e WHERE event_id IN (SELECT event_id FROM ledger) AND event_id NOT IN (SELECT event_id FROM outbox)
 UNION ALL SELECT 'duplicate_jobs', 'error', event_id::VARCHAR FROM outbox GROUP BY event_id, projection_type HAVING count(*) > 1
 UNION ALL SELECT 'in_progress_without_owner', 'error', job_id FROM outbox WHERE status = 'in_progress' AND locked_by IS NULL
 UNION ALL SELECT 'stale_lease', 'warning', job_id FROM outbox WHERE status = 'in_progress' AND {NOW} - locked_at > 3600
 UNION ALL SELECT 'attempts_exhausted', 'error', job_id FROM outbox WHERE attempts > 5 AND status <> 'dead'
 UNION ALL SELECT 'dead_without_reason', 'warning', job_id FROM outbox WHERE status = 'dead' AND last_error IS NULL
 UNION ALL SELECT 'key_mismatch', 'error', job_id FROM outbox WHERE projection_key <> sha256(event_id || chr(31) || projection_type)
 UNION ALL SELECT 'bad_version', 'error', job_id FROM outbox WHERE projection_version < 1)"""


@query("doctor_findings", f"WITH {FIND_SQL} SELECT * FROM f")
def doctor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.doctor(*_three(spark, sf_dir), NOW)


@query("doctor_summary", f"WITH {FIND_SQL} SELECT severity, code, count(*) AS n, max(CASE severity WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END)::INTEGER AS exit_code FROM f GROUP BY ALL")
def doctor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in A.SEVERITY.items() for x in kv])
    return A.doctor(*_three(spark, sf_dir), NOW).groupBy("severity", "code").agg(F.count("*").alias("n"), F.max(rank[F.col("severity")]).alias("exit_code"))


@query("repair_plan", f"WITH {FIND_SQL} SELECT code, CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.RECIPES.items()) + " ELSE 'manual' END AS repair, count(*) AS n FROM f GROUP BY ALL")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repair_plan(A.doctor(*_three(spark, sf_dir), NOW)).groupBy("code", "repair").agg(F.count("*").alias("n"))


@query("doctor_incremental", f"WITH {FIND_SQL} SELECT code, count(*) AS n, max(TRY_CAST(replace(key, 'job-', '') AS BIGINT)) AS high_water FROM f WHERE starts_with(key, 'job-') AND TRY_CAST(replace(key, 'job-', '') AS BIGINT) > 5000 GROUP BY code")
def doctor_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, box, led = _three(spark, sf_dir)
    f = A.doctor(A.since(log, 5000), A.since(box, 5000), A.since(led, 5000), NOW).where(F.col("key").startswith("job-"))
    return f.groupBy("code").agg(F.count("*").alias("n"), F.max(F.replace("key", F.lit("job-"), F.lit("")).cast("bigint")).alias("high_water"))


@query("semi_projection_exists", f"WITH {LOG_SQL} SELECT event_id FROM log e WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.event_id = e.event_id)")
def semi_projection_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _, led = _three(spark, sf_dir)
    return log.select("event_id").join(led.select("event_id"), "event_id", "left_semi")


@query("self_dependency", f"""WITH {OUTBOX_SQL}, c AS (SELECT *, event_id - event_id % 10 AS parent FROM outbox) SELECT job_id, CASE WHEN p.status = 'completed' THEN 'ready' WHEN p.event_id IS NULL THEN 'no_parent' WHEN p.status = 'dead' THEN 'blocked' ELSE 'held' END AS state
FROM c LEFT JOIN (SELECT event_id, status FROM outbox) p ON p.event_id = c.parent AND c.parent <> c.event_id WHERE c.event_id % 10 <> 0""")
def self_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child jobs against their parents, a self-join of the queue."""
    o = outbox(spark, sf_dir)
    child = o.where("event_id % 10 <> 0").select("job_id", (F.col("event_id") - F.col("event_id") % 10).alias("parent"))
    parent = o.select(F.col("event_id").alias("parent"), F.col("status").alias("p"), F.lit(True).alias("there"))
    state = F.when(F.col("p") == "completed", "ready").when(F.col("there").isNull(), "no_parent").when(F.col("p") == "dead", "blocked").otherwise("held")
    return child.join(parent, "parent", "left").select("job_id", state.alias("state"))


@query("replay_scan", f"""WITH {OUTBOX_SQL}, o AS (SELECT event_id, t.projection_type, t.wanted FROM events, (VALUES ('memory', 1), ('label', 2)) t(projection_type, wanted)), j AS (SELECT o.*, b.status, b.locked_at, b.projection_version AS v, b.job_id FROM o LEFT JOIN outbox b ON b.event_id = o.event_id AND b.projection_type = o.projection_type)
SELECT projection_type, CASE WHEN job_id IS NULL THEN 'missing' WHEN status = 'pending' THEN 'pending' WHEN status = 'in_progress' AND {NOW} - locked_at > 3600 THEN 'stale' WHEN status = 'dead' THEN 'dead' WHEN v <> wanted THEN 'version_drift' ELSE 'done' END AS state, count(*) AS n FROM j GROUP BY ALL""")
def replay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.replay_scan(table(spark, sf_dir, "events"), outbox(spark, sf_dir), {"memory": 1, "label": 2}, NOW)
    return r.groupBy("projection_type", "state").agg(F.count("*").alias("n"))


@query("shadow_compare", """WITH l AS (SELECT event_id, user_id, event_type, round(value, 6) AS v FROM events WHERE event_id % 29 <> 0), s AS (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN user_id + 1 ELSE user_id END AS user_id, event_type, round(value + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, 6) AS v FROM events WHERE event_id % 31 <> 0)
SELECT CASE WHEN l.event_id IS NULL THEN 'missing_legacy' WHEN s.event_id IS NULL THEN 'missing_shadow' WHEN l.user_id <> s.user_id THEN 'mismatch_user_id' WHEN l.event_type <> s.event_type THEN 'mismatch_event_type' WHEN l.v <> s.v THEN 'mismatch_v' ELSE 'match' END AS verdict, count(*) AS n FROM l FULL JOIN s ON l.event_id = s.event_id GROUP BY 1""")
def shadow_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    legacy = e.where("event_id % 29 <> 0").select("event_id", "user_id", "event_type", F.round("value", 6).alias("v"))
    bump = F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    shadow = e.where("event_id % 31 <> 0").select("event_id", F.when(F.col("event_id") % 23 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "event_type", F.round(F.col("value") + bump, 6).alias("v"))
    return A.shadow_compare(legacy, shadow, ["user_id", "event_type", "v"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("shadow_leak", f"WITH {LEDGER_SQL} SELECT l.event_id FROM ledger l JOIN outbox o ON o.event_id = l.event_id AND o.tenant <> l.tenant WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_id = l.event_id AND e.event_type = 'purchase')")
def shadow_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outbox(spark, sf_dir).select("event_id", F.col("tenant").alias("own"))
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id")
    return ledger(spark, sf_dir).join(own, "event_id").where("tenant <> own").join(bought, "event_id", "left_semi").select("event_id")


@query("outbox_counts", f"WITH {OUTBOX_SQL}, s(status) AS (VALUES ('pending'), ('in_progress'), ('completed'), ('dead'), ('skipped'), ('blocked')) SELECT s.status, count(o.job_id) AS n FROM s LEFT JOIN outbox o USING (status) GROUP BY 1")
def outbox_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status, with zeros for statuses that none is in."""
    every = spark.createDataFrame([(s,) for s in ("pending", "in_progress", "completed", "dead", "skipped", "blocked")], "status string")
    n = outbox(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("queue_lag", f"WITH {OUTBOX_SQL} SELECT tenant, round({NOW} - min(created_at), 3) AS lag, count(*) AS pending FROM outbox WHERE status = 'pending' GROUP BY tenant")
def queue_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox(spark, sf_dir).where("status = 'pending'").groupBy("tenant").agg(F.round(NOW - F.min("created_at"), 3).alias("lag"), F.count("*").alias("pending"))


@query("claim_queue", f"WITH {OUTBOX_SQL} SELECT job_id, round(least(300.0, 2.0 * 2.0 ** (attempts - 1))::DOUBLE, 6) AS wait FROM outbox WHERE status = 'pending' OR (status = 'in_progress' AND {NOW} - locked_at > 300) ORDER BY created_at, job_id LIMIT 10")
def claim_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten jobs a worker would take next: pending ones, and leases that ran out."""
    o = outbox(spark, sf_dir).where((F.col("status") == "pending") | ((F.col("status") == "in_progress") & (NOW - F.col("locked_at") > 300)))
    return o.orderBy("created_at", "job_id").limit(10).select("job_id", F.round(S.backoff(F.col("attempts")), 6).alias("wait"))


@query("stage_latency", f"WITH {OUTBOX_SQL} SELECT projection_type, count(*) AS n, quantile_disc(completed_at - created_at, 0.5)::DOUBLE AS p50, quantile_disc(completed_at - created_at, 0.95)::DOUBLE AS p95, max(completed_at - created_at)::DOUBLE AS most FROM outbox WHERE status = 'completed' GROUP BY 1")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = F.col("completed_at") - F.col("created_at")
    o = outbox(spark, sf_dir).where("status = 'completed'").withColumn("took", took)
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY took)")
    return o.groupBy("projection_type").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("took").alias("most"))


@query("enqueue_absent", f"WITH {OUTBOX_SQL}, n AS (SELECT event_id, 'memory' AS projection_type FROM events WHERE event_type IN ('purchase', 'error')) SELECT event_id, projection_type FROM n WHERE NOT EXISTS (SELECT 1 FROM outbox o WHERE o.event_id = n.event_id AND o.projection_type = n.projection_type)")
def enqueue_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").select("event_id", F.lit("memory").alias("projection_type"))
    return A.insert_if_absent(outbox(spark, sf_dir), new, ["event_id", "projection_type"])


@query("label_debt", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality >= 0)")
def label_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality >= 0").select("doc_id"), "doc_id", "left_anti")


@query("embedding_debt", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("composed_key_join", "SELECT o.o_orderkey, count(*) AS n_lines, sum(l.l_quantity)::DOUBLE AS quantity FROM orders o JOIN lineitem l ON o.o_orderkey || ':' || 1 = l.l_orderkey || ':' || l.l_linenumber GROUP BY 1")
def composed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on (key, version): two columns rather than one composed string."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("version"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("version"), "l_quantity")
    return o.join(li, ["o_orderkey", "version"]).groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))


@query("dangling_references", """WITH b AS (SELECT conv_id, turn, unnest([conv_id * 10 + turn, conv_id * 70007 + 3]) AS ref FROM conversations) SELECT conv_id, turn, ref FROM b WHERE ref NOT IN (SELECT doc_id FROM documents)""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(F.col("conv_id") * 10 + F.col("turn"), F.col("conv_id") * 70007 + 3)).alias("ref"))
    return b.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref")), "ref", "left_anti").select("conv_id", "turn", "ref")


@query("tombstone_filter", "WITH t AS (SELECT doc_id, seq, placed FROM (SELECT doc_id, 1 AS seq, true AS placed FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, 2, false FROM documents WHERE doc_id % 27 = 0)), d AS (SELECT doc_id FROM t GROUP BY 1 HAVING arg_max(placed, seq)) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d)")
def tombstone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    placed = d.where("doc_id % 9 = 0").select("doc_id", F.lit(1).alias("seq"), F.lit(True).alias("placed"))
    lifted = d.where("doc_id % 27 = 0").select("doc_id", F.lit(2).alias("seq"), F.lit(False).alias("placed"))
    return A.without_tombstoned(d.select("doc_id", "source"), placed.unionByName(lifted), "doc_id")


@query("scope_preview", f"WITH {MEMORIES_SQL} SELECT tenant, workspace, count(*) AS matched, count(*) FILTER (memory_type = 'policy') AS policies FROM memories WHERE contains(lower(content), 'the') AND lifecycle_state <> 'archived' GROUP BY ALL")
def scope_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).where(F.lower("content").contains("the") & (F.col("lifecycle_state") != "archived"))
    return m.groupBy("tenant", "workspace").agg(F.count("*").alias("matched"), F.count_if(F.col("memory_type") == "policy").alias("policies"))


@query("decay_prune", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 10 * exp(-0.3 * (event_id % 20 - 3)) < 3) AS pruned FROM events GROUP BY 1")
def decay_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("event_id") % 10 * F.exp(-0.3 * (F.col("event_id") % 20 - 3)) < 3
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(gone).alias("pruned"))


@query("supersede_scd2", f"WITH {CLAIMS_SQL}, v AS (SELECT *, row_number() OVER w AS version, lead(observed_at) OVER w AS superseded_at FROM claims WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, event_id)) SELECT subject, predicate, version, bucket, observed_at, superseded_at FROM v")
def supersede_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each slot: a new one closes the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject", "predicate").orderBy("observed_at", "event_id")
    return claims(spark, sf_dir).select("subject", "predicate", F.row_number().over(w).cast("bigint").alias("version"), "bucket", "observed_at", F.lead("observed_at").over(w).alias("superseded_at"))


@query("latest_version", f"WITH {CLAIMS_SQL} SELECT subject, predicate, arg_max(event_id, struct_pack(o := observed_at, e := event_id)) AS event_id, count(*) AS versions FROM claims GROUP BY ALL")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).groupBy("subject", "predicate").agg(F.max_by("event_id", F.struct("observed_at", "event_id")).alias("event_id"), F.count("*").alias("versions"))


@query("block_merge", "SELECT md5(text) AS content_hash, count(*) AS puts, max(turn) AS importance, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, sum(greatest(1, (strlen(text) + 3) // 4))::BIGINT AS tokens FROM conversations GROUP BY 1")
def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed blocks: equal contents merge, keeping the highest importance and all sources."""
    from tidemark.functions.text import token_estimate

    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.md5(F.col("text").cast("binary")).alias("content_hash")).agg(F.count("*").alias("puts"), F.max("turn").alias("importance"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


@query("link_table", "WITH l AS (SELECT doc_id AS memory_id, unnest([doc_id * 3, doc_id * 3 + 1, doc_id]) AS event_id FROM documents), x AS (SELECT DISTINCT * FROM l) SELECT event_type, count(*) AS links, count(DISTINCT memory_id) AS memories FROM x JOIN events USING (event_id) GROUP BY 1")
def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    links = table(spark, sf_dir, "documents").select(i.alias("memory_id"), F.explode(F.array_distinct(F.array(i * 3, i * 3 + 1, i))).alias("event_id"))
    return links.join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").groupBy("event_type").agg(F.count("*").alias("links"), F.count_distinct("memory_id").alias("memories"))


@query("projection_equivalence", "SELECT count(*) AS n, count(*) FILTER (abs(value - (value + CASE WHEN event_id % 100 = 0 THEN 0.01 ELSE 0 END)) > 1e-6) AS differing, max(CASE WHEN event_id % 100 = 0 THEN 0.01 ELSE 0 END)::DOUBLE AS most FROM events")
def projection_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projections of the log agree under a contract that allows a small numeric difference."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    other = e.select("event_id", (F.col("value") + F.when(F.col("event_id") % 100 == 0, 0.01).otherwise(0.0)).alias("other"))
    gap = F.round(F.abs(F.col("value") - F.col("other")), 6)
    return e.join(other, "event_id").agg(F.count("*").alias("n"), F.count_if(gap > 1e-6).alias("differing"), F.max(gap).alias("most"))
