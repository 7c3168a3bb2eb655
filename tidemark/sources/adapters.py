"""The engine's tables, derived from the driver's ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about slots (subject, predicate): bucket is the claimed value, kind says how it relates to what was held."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    turn = F.pmod(k, F.lit(10))
    kind = F.when(turn == 0, "correct").when(turn == 1, "conflict").when(turn == 2, "supersede").when(turn.between(3, 5), "repeat").otherwise("assert")
    return e.select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("ts").alias("observed_at"), F.floor(F.col("value") / 50).cast("int").alias("bucket"), k.alias("k"), kind.alias("kind"), "value")


#: the same in DuckDB
CLAIMS_SQL = """claims AS (
  SELECT event_id, user_id AS subject, event_type AS predicate, ts AS observed_at, CAST(floor(value / 50) AS INTEGER) AS bucket, k,
    CASE WHEN k % 10 = 0 THEN 'correct' WHEN k % 10 = 1 THEN 'conflict' WHEN k % 10 = 2 THEN 'supersede' WHEN k % 10 BETWEEN 3 AND 5 THEN 'repeat' ELSE 'assert' END AS kind, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: source is the tenant, lang the workspace; type, trust and states follow from the identifier."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    pick = lambda m, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.col("doc_id"), F.lit(m)) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("memory_id"), F.col("source").alias("tenant"), F.col("lang").alias("workspace"), F.col("text").alias("content"), "n_chars",
        pick(6, "semantic", "episodic", "policy", "procedural", "exception", "causal").alias("memory_type"),
        F.pmod("doc_id", F.lit(6)).cast("int").alias("trust_tier"),
        pick(4, "public", "internal", "confidential", "restricted").alias("security_label"),
        pick(5, "stable", "reinforced", "proposed", "challenged", "archived").alias("lifecycle_state"),
        pick(6, "observed", "reported", "inferred", "hypothesized", "simulated", "verified").alias("epistemic_status"),
        pick(4, "unverified", "machine_checked", "human_approved", "rejected").alias("verification_status"),
        (F.pmod("doc_id", F.lit(101)) / 100.0).alias("confidence"), (F.pmod("doc_id", F.lit(11)) / 10.0).alias("utility"),
        (F.pmod("doc_id", F.lit(7)) / 6.0).alias("salience"), F.pmod("doc_id", F.lit(9)).cast("int").alias("reinforcement"), F.pmod("doc_id", F.lit(4)).cast("int").alias("contradiction"),
        F.col("quality"), F.col("toxic"),
    )


MEMORIES_SQL = """memories AS (
  SELECT d.doc_id AS memory_id, source AS tenant, lang AS workspace, text AS content, n_chars,
    ['semantic', 'episodic', 'policy', 'procedural', 'exception', 'causal'][d.doc_id % 6 + 1] AS memory_type, CAST(d.doc_id % 6 AS INTEGER) AS trust_tier,
    ['public', 'internal', 'confidential', 'restricted'][d.doc_id % 4 + 1] AS security_label,
    ['stable', 'reinforced', 'proposed', 'challenged', 'archived'][d.doc_id % 5 + 1] AS lifecycle_state,
    ['observed', 'reported', 'inferred', 'hypothesized', 'simulated', 'verified'][d.doc_id % 6 + 1] AS epistemic_status,
    ['unverified', 'machine_checked', 'human_approved', 'rejected'][d.doc_id % 4 + 1] AS verification_status,
    (d.doc_id % 101) / 100.0::DOUBLE AS confidence, (d.doc_id % 11) / 10.0::DOUBLE AS utility, (d.doc_id % 7) / 6.0::DOUBLE AS salience,
    CAST(d.doc_id % 9 AS INTEGER) AS reinforcement, CAST(d.doc_id % 4 AS INTEGER) AS contradiction, quality, toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def recallable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with what a recall reads besides: windows, approvals, tags, contexts, labels, and the vectors that there are."""
    i = F.col("memory_id")
    day = lambda n: F.expr(f"timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(cast({n} as int))")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding")
    return memories(spark, sf_dir).select(
        "*", F.when(i % 5 == 0, day("memory_id % 200")).alias("valid_from"), F.when(i % 15 == 0, day("memory_id % 200 + 60")).alias("valid_to"),
        F.when((F.col("memory_type") == "exception") & (i % 4 != 0), "rule").alias("governed_exception_for"), F.when(i % 7 != 0, "owner").alias("approved_by"), F.when(i % 3 == 0, day("memory_id % 300")).alias("approval_expires_at"),
        F.create_map(F.lit("mode"), F.concat(F.lit("m"), (i % 3).cast("string")), F.lit("goal"), F.concat(F.lit("g"), (i % 7).cast("string"))).alias("tags"),
        F.when(i % 3 != 1, F.create_map(F.lit("mode"), F.concat(F.lit("m"), (i % 2).cast("string")), F.lit("risk_level"), F.when(i % 11 == 0, "low").otherwise("high"))).alias("context"),
        (F.col("toxic") == 1).alias("label_junk"), (3 + 4 * F.col("quality")).cast("double").alias("label_importance")).join(v, "memory_id", "left")


RECALLABLE_SQL = MEMORIES_SQL + """, recallable AS (
  SELECT m.*, CASE WHEN memory_id % 5 = 0 THEN TIMESTAMP '2026-01-01' + to_days(CAST(memory_id % 200 AS INTEGER)) END AS valid_from, CASE WHEN memory_id % 15 = 0 THEN TIMESTAMP '2026-01-01' + to_days(CAST(memory_id % 200 + 60 AS INTEGER)) END AS valid_to,
    CASE WHEN memory_type = 'exception' AND memory_id % 4 <> 0 THEN 'rule' END AS governed_exception_for, CASE WHEN memory_id % 7 <> 0 THEN 'owner' END AS approved_by, CASE WHEN memory_id % 3 = 0 THEN TIMESTAMP '2026-01-01' + to_days(CAST(memory_id % 300 AS INTEGER)) END AS approval_expires_at,
    'm' || (memory_id % 3) AS tag_mode, 'g' || (memory_id % 7) AS tag_goal, CASE WHEN memory_id % 3 <> 1 THEN 'm' || (memory_id % 2) END AS ctx_mode, CASE WHEN memory_id % 3 <> 1 THEN CASE WHEN memory_id % 11 = 0 THEN 'low' ELSE 'high' END END AS ctx_risk,
    toxic = 1 AS label_junk, 3 + 4 * quality AS label_importance, e.embedding
  FROM memories m LEFT JOIN embeddings e ON e.vec_id = memory_id)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions, each in a tenant's name (every fifth in all tenants'); every second has a vector."""
    i = F.col("item_id")
    ending = F.when(i % 3 == 0, " timeline").when(i % 3 == 1, " policy").otherwise("")
    v = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("item_id"), "embedding")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", ending).alias("text"), F.when(i % 5 != 0, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("tenant"), F.when(i % 4 == 1, "en").alias("workspace"), F.when(i % 2 == 0, "confidential").otherwise("internal").alias("most"))
    return q.join(v, "item_id", "left")


ASKED_SQL = """asked AS (
  SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' timeline' WHEN 1 THEN ' policy' ELSE '' END AS text, CASE WHEN item_id % 5 <> 0 THEN 'src' || (item_id % 20) END AS tenant, CASE WHEN item_id % 4 = 1 THEN 'en' END AS workspace, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS clearance, e.embedding
  FROM benchmark b LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = item_id)"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection job for each purchase and signup; its state follows from k, so every audit has something to find."""
    c = claims(spark, sf_dir).where(F.col("predicate").isin("purchase", "signup"))
    k = F.col("k")
    status = F.when(k % 10 < 6, "completed").when(k % 10 == 6, "pending").when(k % 10 == 7, "in_progress").when(k % 10 == 8, "dead").otherwise("skipped")
    created = F.col("observed_at").cast("timestamp").cast("double")
    return c.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"), "event_id", F.when(F.col("event_id") % 2 == 0, "memory").otherwise("label").alias("projection_type"),
        (F.lit(1) + F.when(k % 13 == 0, 1).otherwise(0)).alias("projection_version"),
        F.when(k % 17 == 0, F.lit("damaged")).otherwise(content_hash(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "memory").otherwise("label"))).alias("projection_key"),
        F.concat(F.lit("t"), (F.col("subject") % 5).cast("string")).alias("tenant"), status.alias("status"), (k % 7).cast("int").alias("attempts"), created.alias("created_at"),
        F.when(status == "in_progress", F.when(k % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit("w"), (k % 3).cast("string")))).alias("locked_by"),
        F.when(status == "in_progress", created + k * 100).alias("locked_at"), F.when((status == "dead") & (k % 3 == 0), "boom").alias("last_error"), F.when(status == "completed", created + k).alias("completed_at"), "k",
    )


OUTBOX_SQL = CLAIMS_SQL + """, base AS (
  SELECT *, CASE WHEN k % 10 < 6 THEN 'completed' WHEN k % 10 = 6 THEN 'pending' WHEN k % 10 = 7 THEN 'in_progress' WHEN k % 10 = 8 THEN 'dead' ELSE 'skipped' END AS status,
    epoch_us(observed_at) / 1e6 AS created_at, CASE WHEN event_id % 2 = 0 THEN 'memory' ELSE 'label' END AS projection_type
  FROM claims WHERE predicate IN ('purchase', 'signup')),
outbox AS (
  SELECT 'job-' || event_id AS job_id, event_id, projection_type, CAST(1 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS INTEGER) AS projection_version,
    CASE WHEN k % 17 = 0 THEN 'damaged' ELSE sha256(event_id || chr(31) || projection_type) END AS projection_key, 't' || (subject % 5) AS tenant, status, CAST(k % 7 AS INTEGER) AS attempts, created_at,
    CASE WHEN status = 'in_progress' AND k % 4 <> 3 THEN 'w' || (k % 3) END AS locked_by, CASE WHEN status = 'in_progress' THEN created_at + k * 100 END AS locked_at,
    CASE WHEN status = 'dead' AND k % 3 = 0 THEN 'boom' END AS last_error, CASE WHEN status = 'completed' THEN created_at + k END AS completed_at, k
  FROM base)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was projected: all jobs' events but every seventh, a few under another tenant."""
    o = outbox(spark, sf_dir).where("event_id % 7 <> 0")
    return o.select("projection_key", "event_id", "projection_type", F.when(F.col("event_id") % 97 == 0, "other").otherwise(F.col("tenant")).alias("tenant"), F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("target_id"))


LEDGER_SQL = OUTBOX_SQL + """, ledger AS (
  SELECT projection_key, event_id, projection_type, CASE WHEN event_id % 97 = 0 THEN 'other' ELSE tenant END AS tenant, 'm-' || event_id AS target_id FROM outbox WHERE event_id % 7 <> 0)"""
