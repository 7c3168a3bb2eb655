"""Queries of episode search, belief and persona ranking, bundles, consolidation and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import retrieval as R
from tidemark.plans.registry import query
from tidemark.plans.retrieval import DT, QT
from tidemark.sources.adapters import CLAIMS_SQL, MEMORIES_SQL, claims, memories, table

_WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1)"


@query("persona_rank", f"""WITH {MEMORIES_SQL}, r AS (SELECT memory_id, memory_type AS layer, round((0.45 * len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')), ['the', 'of', 'and', 'die', 'que'])) / 5.0 + confidence + least(0.05 * reinforcement, 0.25) + CASE WHEN workspace = 'en' THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM memories)
SELECT layer, memory_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, memory_id) AS rank FROM r) WHERE rank <= 6""")
def persona_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    overlap = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ("the", "of", "and", "die", "que")]))) / 5.0
    score = F.round(0.45 * overlap + F.col("confidence") + F.least(0.05 * F.col("reinforcement"), F.lit(0.25)) + F.when(F.col("workspace") == "en", 0.1).otherwise(0.0), 6)
    return R.ranked(memories(spark, sf_dir).select(F.col("memory_type").alias("layer"), "memory_id", score.alias("score")), "layer", [F.desc("score"), "memory_id"], 6)


@query("episode_pool", "WITH a AS (SELECT conv_id, turn, 0 AS stage FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 60), b AS (SELECT conv_id, turn, 1 AS stage FROM conversations WHERE contains(lower(text), 'tion') OR contains(lower(text), 'heit')), c AS (SELECT conv_id, turn, 2 AS stage FROM conversations WHERE role = 'system') SELECT conv_id, turn, min(stage)::INTEGER AS stage FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY ALL")
def episode_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent turns, a lexical sweep of all history and anchors; the first stage that names a turn keeps it."""
    c = table(spark, sf_dir, "conversations")
    low = F.lower("text")
    stage = lambda rows, n: rows.select("conv_id", "turn", F.lit(n).alias("stage"))
    recent = c.select("conv_id", "turn").orderBy(F.desc("conv_id"), F.desc("turn")).limit(60)
    pool = stage(recent, 0).unionByName(stage(c.where(low.contains("tion") | low.contains("heit")), 1)).unionByName(stage(c.where("role = 'system'"), 2))
    return pool.groupBy("conv_id", "turn").agg(F.min("stage").alias("stage"))


@query("scope_resolution", "SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN 'explicit-' || role END, CASE WHEN turn % 3 = 1 THEN 'env-' || (conv_id % 4) END, 'default') AS scope, CASE WHEN turn % 3 = 0 THEN 'argument' WHEN turn % 3 = 1 THEN 'environment' ELSE 'fallback' END AS resolved_by FROM conversations")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit scope before the environment's before the default."""
    explicit = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("explicit-"), F.col("role")))
    env = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("env-"), (F.col("conv_id") % 4).cast("string")))
    by = F.when(explicit.isNotNull(), "argument").when(env.isNotNull(), "environment").otherwise("fallback")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(explicit, env, F.lit("default")).alias("scope"), by.alias("resolved_by"))


@query("scope_doctor", "WITH s AS (SELECT source AS tenant, lang AS workspace, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT tenant, count(*) AS workspaces, max(n) / sum(n)::DOUBLE AS share FROM s GROUP BY 1) SELECT tenant, workspaces, round(share, 6) AS share, CASE WHEN workspaces > 3 AND share < 0.7 THEN 'split' WHEN workspaces = 1 THEN 'single' ELSE 'ok' END AS diagnosis FROM t")
def scope_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("tenant"), F.col("lang").alias("workspace")).agg(F.count("*").alias("n"))
    t = s.groupBy("tenant").agg(F.count("*").alias("workspaces"), (F.max("n") / F.sum("n")).alias("share"))
    return t.select("tenant", "workspaces", F.round("share", 6).alias("share"), F.when((F.col("workspaces") > 3) & (F.col("share") < 0.7), "split").when(F.col("workspaces") == 1, "single").otherwise("ok").alias("diagnosis"))


@query("slot_redaction", r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g')) AS text_md5, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: length(x) >= 6))::INTEGER AS fragments FROM documents")
def slot_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a redaction removed, in fragments of six characters or more, so that supplied slots lose it too."""
    p = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    cut = F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda x: F.length(x) >= 6)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", p, "[REDACTED]").cast("binary")).alias("text_md5"), F.size(cut).alias("fragments"))


@query("access_counts", f"WITH {MEMORIES_SQL}, a AS (SELECT event_id % 1000 AS memory_id, count(*) AS reads, max(ts) AS last_read FROM events WHERE event_type = 'view' GROUP BY 1) SELECT m.memory_id, m.reinforcement + coalesce(reads, 0) AS retrieval_count, last_read, round(least(4.0, 1 + 0.6 * ln(1 + coalesce(reads, 0)))::DOUBLE, 6) AS durability FROM memories m LEFT JOIN a USING (memory_id)")
def access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads are an append-only log; counters and durability come from merging it, not from writing on read."""
    a = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy((F.col("event_id") % 1000).alias("memory_id")).agg(F.count("*").alias("reads"), F.max("ts").alias("last_read"))
    n = F.coalesce("reads", F.lit(0))
    return memories(spark, sf_dir).join(a, "memory_id", "left").select("memory_id", (F.col("reinforcement") + n).alias("retrieval_count"), "last_read", F.round(S.durability(n), 6).alias("durability"))
