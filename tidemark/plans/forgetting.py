"""Queries of forgetting and of what it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import forgetting as G
from tidemark.plans.knowledge import stated, templated
from tidemark.plans.registry import query
from tidemark.sources.adapters import MEMORIES_SQL, OUTBOX_SQL, memories, outbox, table


@query("forget_restore", f"""WITH {MEMORIES_SQL}, m AS (SELECT *, memory_id % 4 AS k FROM memories)
SELECT memory_id, (CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 1 END)::INTEGER AS version, CASE k WHEN 0 THEN 'forgotten' WHEN 1 THEN lifecycle_state WHEN 2 THEN 'superseded' ELSE lifecycle_state END AS state, CASE WHEN k = 0 THEN 10 END::BIGINT AS forgotten_at FROM m""")
def forget_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions after memories were forgotten, forgotten and restored, or superseded, forgotten and restored at once."""
    m = memories(spark, sf_dir)
    v = m.select("memory_id", F.lit(1).alias("version"), F.col("lifecycle_state").alias("state"), F.lit(None).cast("bigint").alias("forgotten_at"))
    k = F.col("memory_id") % 4
    todo = F.when(k == 0, F.array(F.lit("forget:10"))).when(k == 1, F.array(F.lit("forget:10"), F.lit("restore:20"))).when(k == 2, F.array(F.lit("supersede:5"), F.lit("restore:20"))).otherwise(F.array().cast("array<string>"))
    a = m.select("memory_id", F.explode(todo).alias("a")).withColumn("a", F.split("a", ":")).select("memory_id", F.col("a")[0].alias("action"), F.col("a")[1].cast("bigint").alias("at"))
    return G.newest(G.acted(v, a))


NEEDLE = "tion"


def _stores(spark: SparkSession, sf_dir: str) -> dict[str, tuple]:
    """Memories, what was derived from them, and the log: an event for each document, a consolidation for each three."""
    m = memories(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    groups = d.groupBy(F.floor(F.col("doc_id") / 3).alias("group_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.left(x["text"], F.lit(200))), " ").alias("text"))
    return {
        "memories": (m.select("memory_id", F.col("content").alias("text")), "memory_id"), "embeddings": (table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id")), "memory_id"), "labels": (table(spark, sf_dir, "labels").select(F.col("doc_id").alias("memory_id")), "memory_id"),
        "consolidated": (groups, "sources", "group_id"), "events": (d.select(F.col("doc_id").alias("memory_id"), "text"), "memory_id"),
    }


_GONE = f"d AS (SELECT doc_id AS i, text FROM documents), gone AS (SELECT i FROM d WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), '{NEEDLE}')), g AS (SELECT i // 3 AS k, bool_or(i IN (SELECT i FROM gone)) AS hit FROM d GROUP BY 1)"
_LEFT = {
    "memories": "(SELECT count(*) FROM d WHERE i NOT IN (SELECT i FROM gone))", "embeddings": "(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT i FROM gone))", "labels": "(SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT i FROM gone))",
    "consolidated": "(SELECT count(*) FROM g WHERE NOT hit)", "events": "(SELECT count(*) FROM d WHERE i NOT IN (SELECT i FROM gone))",
}
_ALL = {"memories": "(SELECT count(*) FROM d)", "embeddings": "(SELECT count(*) FROM embeddings)", "labels": "(SELECT count(*) FROM labels)", "consolidated": "(SELECT count(*) FROM g)", "events": "(SELECT count(*) FROM d)"}
_LEVEL_ROWS = [f"SELECT '{level}' AS level, '{name}' AS store, {(_LEFT if name in names else _ALL)[name]} AS rows_left" for level, names in G.LEVELS.items() for name in _ALL]


@query("three_level_forget", f"WITH {_GONE} " + " UNION ALL ".join(_LEVEL_ROWS))
def three_level_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each store after a subject was forgotten at each level."""
    stores = _stores(spark, sf_dir)
    gone = G.targets(stores["memories"][0].withColumnRenamed("text", "content"), NEEDLE)
    out = [rows.agg(F.count("*").alias("rows_left")).select(F.lit(level).alias("level"), F.lit(name).alias("store"), "rows_left") for level in G.LEVELS for name, rows in G.erased(stores, gone, level).items()]
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first


@query("forget_residue", f"""WITH {_GONE}, c AS (SELECT i // 3 AS k, lower(regexp_replace(string_agg(left(text, 200), ' ' ORDER BY i), '\\s+', ' ', 'g')) AS x FROM d GROUP BY 1)
SELECT level, store, residue, checked FROM (SELECT 'projection' AS level, 'memories' AS store, 0::BIGINT AS residue, {_LEFT['memories']} AS checked UNION ALL SELECT 'projection', 'consolidated', (SELECT count(*) FROM c WHERE contains(x, '{NEEDLE}')), {_ALL['consolidated']} UNION ALL SELECT 'projection', 'events', (SELECT count(*) FROM gone), {_ALL['events']}
 UNION ALL SELECT 'derived', 'memories', 0, {_LEFT['memories']} UNION ALL SELECT 'derived', 'consolidated', (SELECT count(*) FROM c JOIN g USING (k) WHERE NOT hit AND contains(x, '{NEEDLE}')), {_LEFT['consolidated']} UNION ALL SELECT 'derived', 'events', (SELECT count(*) FROM gone), {_ALL['events']}
 UNION ALL SELECT 'history', 'memories', 0, {_LEFT['memories']} UNION ALL SELECT 'history', 'consolidated', (SELECT count(*) FROM c JOIN g USING (k) WHERE NOT hit AND contains(x, '{NEEDLE}')), {_LEFT['consolidated']} UNION ALL SELECT 'history', 'events', 0, {_LEFT['events']})""")
def forget_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the forgotten text is still found after each level: only the last one leaves nothing in the log."""
    stores = _stores(spark, sf_dir)
    gone = G.targets(stores["memories"][0].withColumnRenamed("text", "content"), NEEDLE)
    out = None
    for level in G.LEVELS:
        left = G.erased(stores, gone, level)
        found = G.residue({n: (left[n], "text") for n in ("memories", "consolidated", "events")}, NEEDLE).select(F.lit(level).alias("level"), "store", "residue", "checked")
        out = found if out is None else out.unionByName(found)
    return out


@query("workspace_purge", f"WITH {MEMORIES_SQL} SELECT 'memories' AS store, workspace, count(*) AS n FROM memories WHERE NOT (tenant = 'src1' AND workspace = 'en') GROUP BY 2 UNION ALL SELECT 'jobs', CASE WHEN subject % 3 = 0 THEN 'en' WHEN subject % 3 = 1 THEN 'de' END, count(*) FROM (SELECT user_id AS subject FROM events) WHERE NOT (subject % 2 = 1 AND subject % 3 = 0) GROUP BY 2")
def workspace_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in each store after a workspace of one tenant was purged; rows of no workspace stay."""
    u = F.col("user_id")
    jobs = table(spark, sf_dir, "events").select(F.when(u % 2 == 1, "src1").otherwise("src2").alias("tenant"), F.when(u % 3 == 0, "en").when(u % 3 == 1, "de").alias("workspace"))
    left = G.purged({"memories": memories(spark, sf_dir).select("tenant", "workspace"), "jobs": jobs}, "src1", "en")
    counts = [rows.groupBy("workspace").agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "workspace", "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1])


@query("in_flight_events", f"WITH {OUTBOX_SQL} SELECT DISTINCT event_id FROM outbox JOIN events USING (event_id) WHERE status IN ('pending', 'in_progress', 'dead') AND contains(lower(props), '\"k\": 1')")
def in_flight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"))
    return G.in_flight(outbox(spark, sf_dir), e, '"k": 1')


@query("payload_redaction", f"SELECT doc_id, md5(regexp_replace(text, '{NEEDLE}', '[ERASED]', 'gi')) AS text_md5, regexp_matches(text, '{NEEDLE}', 'i') AS changed FROM documents")
def payload_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with a string erased, and which of them held it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", G.redacted(F.col("text"), NEEDLE).alias("new"))
    return d.select("doc_id", F.md5(F.col("new").cast("binary")).alias("text_md5"), (F.col("new") != F.col("text")).alias("changed"))


@query("deletion_probes", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x FROM conversations), p AS (SELECT conv_id, turn, list_concat(CASE WHEN length(x) >= 8 THEN [x] ELSE [] END, regexp_extract_all(x, '\S{6,}')) AS l FROM t)
SELECT conv_id, turn, md5(array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:8], chr(31))) AS probes FROM p""")
def deletion_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that would betray each text after its deletion."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(G.probes(F.col("text")), "\x1f").cast("binary")).alias("probes"))


REQUESTS = [
    ("Please forget everything about Trần Hà", "Trần Hà", None), ("Hãy xóa thông tin lương của anh Bùi Cường", "Bùi Cường", "lương"), ("delete the phone data", None, "phone"), ("Forget Minh and Lê Văn Tú salary history", "Lê Văn Tú", "minh and salary history"), ("", None, None),
]


@query("deletion_scope", stated(REQUESTS, "subject", "topic"))
def deletion_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom and what each request wants forgotten."""
    return templated(spark, sf_dir, REQUESTS).select("doc_id", G.scope(F.col("x")).alias("s")).select("doc_id", F.col("s.subject").alias("subject"), F.col("s.topic").alias("topic"))


MENTIONED = [("Trần Văn Hà đi làm", True), ("trần  HÀng xóm", True), ("Hà ở đây", False), ("", False)]


@query("subject_substring", stated(MENTIONED, "found"))
def subject_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion looks for a subject's words anywhere, within other words too, so that it rather takes too much."""
    return templated(spark, sf_dir, MENTIONED).select("doc_id", G.mentions(F.col("x"), F.lit("Trần Hà")).alias("found"))


HELD = [("lương của A là 5 triệu", "match"), ("A sống ở Huế", "other"), ("hôm nay trời đẹp", "abstained"), ("mức lương 7", "match"), ("số điện thoại 09", "other")]


@query("predicate_deletion", stated(HELD, "verdict"))
def predicate_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which memories a request about salaries means, and which of them can't be judged."""
    return G.by_predicate(templated(spark, sf_dir, HELD).withColumnRenamed("x", "content"), "salary").select("doc_id", "verdict")


