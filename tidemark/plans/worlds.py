"""Queries of evaluation worlds, and of the sources that have no table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import matching as M
from tidemark.operators import worlds as W
from tidemark.plans.registry import query
from tidemark.plans.retrieval import DT, QT, TOK
from tidemark.sources import stores
from tidemark.sources.adapters import table
from tidemark.sources.scratch import folder

TICKS, SLOTS, STILL, SEED = 1000, 40, 7, 20260814
_R = lambda what: f"(('0x' || substr(md5('{SEED}|{what}|' || tick), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
WORLD_SQL = f"""ticks AS (SELECT unnest(range(1, {TICKS} + 1)) AS tick), raw AS (SELECT tick, floor({_R('slot')} * {SLOTS})::INTEGER AS slot, {_R('kind')} AS r, floor({_R('value')} * 9)::INTEGER AS v FROM ticks), ord AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY tick) AS i FROM raw),
w AS (SELECT slot, 0::BIGINT AS i, 0::BIGINT AS tick, false AS has, ''::VARCHAR AS kind, 0 AS v FROM (SELECT DISTINCT slot FROM raw)
  UNION ALL SELECT slot, i, tick, CASE kind WHEN 'forget' THEN false WHEN 'assert' THEN true ELSE had END, kind, v FROM (SELECT o.slot, o.i, o.tick, w.has AS had, o.v, CASE WHEN NOT w.has THEN CASE WHEN r < 0.85 THEN 'assert' ELSE 'noise' END WHEN o.slot % {STILL} = 0 THEN CASE WHEN r < 0.7 THEN 'repeat' WHEN r < 0.85 THEN 'correct' ELSE 'noise' END
    WHEN r < 0.28 THEN 'repeat' WHEN r < 0.28 + 0.26 * (o.tick / {TICKS}::DOUBLE) THEN 'supersede' WHEN r < 0.62 THEN 'noise' WHEN r < 0.72 THEN 'contradict' WHEN r < 0.80 THEN 'correct' WHEN r < 0.84 AND o.tick / {TICKS}::DOUBLE > 0.25 THEN 'forget' ELSE 'repeat' END AS kind FROM w JOIN ord o ON o.slot = w.slot AND o.i = w.i + 1)),
world AS (SELECT tick, slot, kind, v AS value FROM w WHERE i > 0)"""
_TEXT = "CASE kind " + " ".join(f"WHEN '{k}' THEN replace(replace('{s}', '%', 'slot ' || slot), '$', value::VARCHAR)" for k, s in W.SENTENCES.items()) + " END"


@query("world_generator", f"WITH RECURSIVE {WORLD_SQL} SELECT tick, slot, kind, value, {_TEXT} AS text FROM world")
def world_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of a seeded life; the same on every run and cluster."""
    return W.world(spark, TICKS, SLOTS, STILL, SEED)


_TRUTH = f"""{WORLD_SQL}, st AS (SELECT slot, arg_max(CASE WHEN kind <> 'forget' THEN value ELSE -1 END, tick) AS x FROM world WHERE kind IN ('assert', 'supersede', 'correct', 'forget') GROUP BY 1), tl AS (SELECT slot, arg_min(value, tick) AS first, arg_max(value, tick) AS latest, count(*) FILTER (kind = 'supersede') AS changed FROM world WHERE kind IN ('assert', 'supersede', 'correct', 'contradict') GROUP BY 1),
q AS (SELECT slot, CASE WHEN x >= 0 THEN x END AS value, first, latest, changed FROM tl LEFT JOIN st USING (slot))"""
_SCORES = {"perfect": "true", "first_value": "first IS NOT DISTINCT FROM value", "latest_mention": "latest IS NOT DISTINCT FROM value", "never_declines": "coalesce(value, latest) IS NOT DISTINCT FROM value", "always_declines": "value IS NULL", "plausible_wrong": "(coalesce(value, 0) + 1) % 9 IS NOT DISTINCT FROM value"}
_SCORED = " UNION ALL ".join(f"SELECT '{n}' AS answerer, round(avg(({e})::INTEGER), 6) AS score FROM q" for n, e in _SCORES.items())


@query("answerers", f"WITH RECURSIVE {_TRUTH} {_SCORED}")
def answerers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six answerers, right and wrong in known ways, against the world's ledger."""
    return W.scored(W.truth(W.world(spark, TICKS, SLOTS, STILL, SEED)))


@query("integrity_report", f"""WITH RECURSIVE {_TRUTH}, sc AS ({_SCORED}), qq AS (SELECT CASE WHEN slot % 5 = 0 THEN 'historical' ELSE 'current' END AS family, CASE WHEN value IS NULL THEN 'decline' ELSE 'value' END AS expect FROM q), f AS (SELECT family, count(*) AS n FROM qq GROUP BY 1), k AS (SELECT family, max(c) AS k, sum(c) AS n FROM (SELECT family, expect, count(*) AS c FROM qq GROUP BY ALL) GROUP BY 1), b AS (SELECT score AS best FROM sc WHERE answerer = 'perfect')
SELECT 'small_family' AS "check", family AS subject, n::DOUBLE AS figure FROM f WHERE n < 8 UNION ALL SELECT 'skewed_family', family, round(k / n::DOUBLE, 6) FROM k WHERE n >= 8 AND k / n::DOUBLE > 0.85 UNION ALL SELECT 'rare_event', kd, c::DOUBLE FROM (SELECT kd, (SELECT count(*) FROM world WHERE kind = kd) AS c FROM (SELECT unnest(['repeat', 'supersede', 'correct', 'forget']) AS kd)) WHERE c < 10
UNION ALL SELECT 'unreachable', answerer, score FROM sc WHERE answerer = 'perfect' AND score < 0.95 UNION ALL SELECT 'too_near', answerer, round(best - score, 6) FROM sc, b WHERE answerer <> 'perfect' AND best - score < 0.15""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the questions of this world can tell right answerers from wrong ones, and where they can't."""
    world = W.world(spark, TICKS, SLOTS, STILL, SEED)
    q = W.truth(world)
    asked = q.select(F.when(F.col("slot") % 5 == 0, "historical").otherwise("current").alias("family"), F.when(F.col("value").isNull(), "decline").otherwise("value").alias("expect"))
    return W.integrity(asked, world, W.scored(q))


@query("naive_rag", f"""WITH {DT}, {QT}, l AS (SELECT doc_id, len({TOK}) AS dl FROM documents), kk AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(dl) FROM l) AS a), df AS (SELECT term, count(*) AS df FROM dt GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)))::DOUBLE, 6) AS score FROM qt JOIN dt USING (term) JOIN df USING (term) JOIN l USING (doc_id), kk GROUP BY item_id, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s),
j AS (SELECT b.item_id, rank, contains(lower(d.text), lower(left(b.text, 30))) AS found FROM benchmark b LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r USING (item_id) LEFT JOIN documents d USING (doc_id)) SELECT item_id, coalesce(bool_or(found), false) AS hit, min(rank) FILTER (found) AS first_rank FROM j GROUP BY 1""")
def naive_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline without a memory: is the beginning of each passage in the five documents that rank best for it?"""
    b = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents")
    return W.naive_rag(M.bm25(d.select("doc_id", "text"), b.select("item_id", "text"), 5), d, b.select("item_id", F.left("text", F.lit(30)).alias("answer")))


def _nested(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as nested JSON: a sample each, its turns, and a question about its first and last turn."""
    path = folder(spark, "nested")
    c = table(spark, sf_dir, "conversations")
    turn = F.struct(F.col("role").alias("speaker"), F.concat(F.lit("D"), F.col("turn").cast("string")).alias("dia_id"), "text", F.lit(1).alias("session_id"), F.lit("2026-01-01").alias("session_datetime"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]).alias("turns"), F.max("turn").alias("last"), F.min("turn").alias("low"))
    qa = F.array(F.struct(F.lit("what?").alias("question"), F.lit(1).alias("category"), F.lit("a").alias("answer"), F.array(F.concat(F.lit("D"), F.col("low").cast("string")), F.concat(F.lit("D"), F.col("last").cast("string"))).alias("evidence")))
    g.select(F.col("conv_id").cast("string").alias("sample_id"), "turns", qa.alias("qa")).write.json(path)
    return path


@query("conversation_loader", "SELECT conv_id::VARCHAR AS sample_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, role AS speaker, 'D' || turn AS dia_id, md5(text) AS text_md5 FROM conversations")
def conversation_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read from nested JSON files."""
    turns, _ = stores.load_conversations(spark, _nested(spark, sf_dir), lines=True)
    return turns.select("sample_id", "pos", "speaker", "dia_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("answerable_questions", "WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id::VARCHAR AS sample_id FROM c WHERE last < 6")
def answerable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions all of whose evidence was ingested, when only the first six turns were."""
    turns, qa = stores.load_conversations(spark, _nested(spark, sf_dir), lines=True)
    return stores.answerable(qa, turns.where(F.substring("dia_id", 2, 9).cast("int") < 6).select("sample_id", "dia_id")).select("sample_id")


@query("import_once", "SELECT 'empty' AS target, count(*) AS n FROM conversations UNION ALL SELECT 'filled', count(*) FROM conversations WHERE role = 'user'")
def import_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legacy file is taken in by an empty table, and ignored by one that has rows."""
    path = folder(spark, "legacy")
    c = table(spark, sf_dir, "conversations")
    stores.write_jsonl(c, path)
    legacy = stores.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")
    n = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n")
    return n(stores.import_once(c.limit(0), legacy), "empty").unionByName(n(stores.import_once(c.where("role = 'user'"), legacy), "filled"))


@query("file_inventory", "SELECT '.json' AS suffix, 3::BIGINT AS n, true AS sized, 'personal' AS sensitivity UNION ALL SELECT '.txt', 2, true, 'secret'")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by suffix, with what their texts hold: secrets before personal data before nothing."""
    rows = [("x/1.json", '{"mail": "a.b@example.com"}'), ("x/2.json", "{}"), ("x/y/3.JSON", "[]"), ("x/4.txt", "password: hunter2secret"), ("x/5.txt", "call +49 170 1234567"), ("x/6.bin", "zz")]
    return stores.inventory_of(spark.createDataFrame(rows, "path string, content string"), (".json", ".txt"))


@query("jdbc_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jdbc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to one database, copied to another in ranges of its key, and read back. The databases are embedded ones of the driver."""
    import os
    import tempfile

    nation = table(spark, sf_dir, "nation")
    with tempfile.TemporaryDirectory(prefix="tidemark-") as top:
        a, b = (f"jdbc:derby:{os.path.realpath(top)}/{x};create=true" for x in "ab")
        stores.write_table(nation, a, "nation", createTableColumnTypes="n_name VARCHAR(64)")
        stores.copy_table(spark, a, b, "nation", key='"n_nationkey"', parts=3, low=0, high=25)
        got = stores.read_table(spark, b, "nation").select(*nation.columns)
        for url in (a, b):
            stores.closed(spark, url)
    return got


@query("vector_scroll", "SELECT vec_id, label, ((row_number() OVER (ORDER BY vec_id) - 1) // 64)::INTEGER AS page FROM embeddings WHERE vec_id % 10 <> 3")
def vector_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector index after upserts and deletions, read page by page: each page is a filter on the key, so none reads what is before it."""
    e = table(spark, sf_dir, "embeddings")
    path = folder(spark, "vectors")
    stores.VectorIndex(spark, path).upsert(e.withColumn("label", F.lit(-1)))
    index = stores.VectorIndex(spark, path)
    index.upsert(e)
    index.delete(e.where("vec_id % 10 = 3").select("vec_id"))
    return index.pages(64).select("vec_id", "label", "page")
