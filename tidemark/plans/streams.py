"""Streaming queries, each with the SQL of its batch twin, and source/sink round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quantiles import nearest_rank_time
from tidemark.plans.registry import query
from tidemark.sources import stores
from tidemark.sources.adapters import MEMORIES_SQL, memories, table
from tidemark.sources.scratch import folder
from tidemark.streaming import projection as P


@query("stream_project", "SELECT event_id, event_type, sha256(event_id || chr(31) || event_type) AS projection_key FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 9 <> 0")
def stream_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "events").where("event_id % 9 = 0").select("event_id")
    stream = P.project(P.events_stream(spark, f"{sf_dir}/events.parquet"), gone)
    return P.drained(stream, "project", each=lambda batch: batch.select("event_id", "event_type", "projection_key"))


@query("stream_windowed", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.drained(P.windowed(P.events_stream(spark, f"{sf_dir}/events.parquet"), "1 day"), "windowed", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_retry_state", "SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 5 THEN 'dead' ELSE 'pending' END AS status FROM events WHERE event_type = 'error' GROUP BY 1")
def stream_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each key: later updates have more attempts."""
    out = P.drained(P.retries(P.events_stream(spark, f"{sf_dir}/events.parquet")), "retries", "update")
    return out.groupBy("user_id").agg(F.max("attempts").alias("attempts"), F.max_by("status", "attempts").alias("status"))


@query("append_log", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, 64 AS width FROM events GROUP BY 1")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two atomic appends to a log, read back with their checksums."""
    e = table(spark, sf_dir, "events")
    path = folder(spark, "log")
    for part in (0, 1):
        stores.append_events(e.where(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.max(F.length("checksum")).alias("width"))


@query("owed_projections", "SELECT event_id, t AS projection_type, 1 AS projection_version, sha256(event_id || chr(31) || t || chr(31) || '1') AS projection_key FROM events, unnest(['memory', 'label']) AS u(t) WHERE event_type = 'signup'")
def owed_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.owed(table(spark, sf_dir, "events").where("event_type = 'signup'"), ["memory", "label"])


@query("event_lookup", "SELECT * FROM events WHERE event_id = 77 AND user_id % 1 = 0")
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id = 77")


@query("newest_events", "SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 25")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)


@query("recent_turns", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.tail(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 20, "conv_id", "turn")


@query("active_scan", f"WITH {MEMORIES_SQL} SELECT memory_id FROM memories WHERE lifecycle_state <> 'archived' AND tenant = 'src2' AND (workspace = 'en' OR workspace IS NULL)")
def active_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where("lifecycle_state <> 'archived' and tenant = 'src2' and (workspace = 'en' or workspace is null)").select("memory_id")


@query("jsonl_round_trip", "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, path = table(spark, sf_dir, "conversations"), folder(spark, "jsonl")
    stores.write_jsonl(c, path)
    return stores.read_jsonl(spark, path, "conv_id long, turn long, role string, text string").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("hook_ingest", "SELECT event_id, 'type=' || event_type || ' | user=' || user_id AS content FROM events WHERE event_type <> 'view'")
def hook_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hooks = e.select("event_id", F.when(F.col("event_type") == "view", "heartbeat").otherwise("tool").alias("hook"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")).alias("fields"))
    return stores.hook_events(hooks).select("event_id", "content")


@query("upsert_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    return stores.upserted(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), ["user_id"], "seq")


@query("audit_replay", "SELECT event_id, ts, event_type FROM events WHERE ts BETWEEN (SELECT quantile_disc(ts, 0.4) FROM events) AND (SELECT quantile_disc(ts, 0.5) FROM events)")
def audit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    at = lambda q: nearest_rank_time(e, "ts", q)
    return e.where((F.col("ts") >= at(0.4)) & (F.col("ts") <= at(0.5)))
