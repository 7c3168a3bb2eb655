"""Queries of episode search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import episodes as E
from tidemark.plans.registry import query
from tidemark.plans.retrieval import DT, TOK
from tidemark.sources.adapters import table

POOL, LIMIT = 40, 9


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as episodes; every tenth is an anchor, every twentieth has a value."""
    i = F.col("doc_id")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    kind = F.when(i % 10 == 0, F.when(F.floor(i / 10) % 2 == 0, "verification_code").otherwise("special_character"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", (i % 48).cast("double").alias("age_hours"), (i % 10 == 0).alias("is_anchor"), kind.alias("anchor_kind"), (i % 20 == 0).alias("anchor_value")).join(v, "doc_id", "left")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    v = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf_dir, "benchmark").select("item_id", "text", F.when(i % 7 == 0, "verification_code").when(i % 7 == 1, "special_character").alias("anchor_kind")).join(v, "item_id", "left")


_FOLD = lambda c: f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
EP = f"""{DT}, nt AS (SELECT doc_id, count(*) AS terms FROM dt GROUP BY 1), dfs AS (SELECT term, count(*) AS df FROM dt GROUP BY 1),
ep AS (SELECT d.doc_id, {_FOLD('text')} AS body, (d.doc_id % 48)::DOUBLE AS age, d.doc_id % 10 = 0 AS anchor, CASE WHEN d.doc_id % 10 = 0 THEN CASE WHEN d.doc_id // 10 % 2 = 0 THEN 'verification_code' ELSE 'special_character' END END AS kind, d.doc_id % 20 = 0 AS valued, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
qs AS (SELECT item_id, text, CASE item_id % 7 WHEN 0 THEN 'verification_code' WHEN 1 THEN 'special_character' END AS asks, e.embedding FROM benchmark b LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = item_id)"""


def _search(q: str, at: str, pool: int) -> str:
    """CTEs that search for the queries of the table q (item_id, text, asks, embedding); the ranked pool is {at}."""
    return f"""{at}_t AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TOK}) AS term FROM {q})), {at}_w AS (SELECT item_id, term, ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(df, 0))::DOUBLE) AS idf FROM {at}_t LEFT JOIN dfs USING (term)), {at}_m AS (SELECT item_id, sum(idf) AS mass FROM {at}_w GROUP BY 1),
{at}_c AS (SELECT item_id, doc_id, sum(idf) AS got, count(*) AS shared FROM {at}_w JOIN dt USING (term) GROUP BY ALL),
{at}_p AS (SELECT m.item_id, e.*, q.asks, coalesce(got, 0) / mass AS cov, coalesce(shared, 0) AS shared, coalesce(terms, 0) AS terms, {_FOLD('q.text')} AS needle, CASE WHEN e.embedding IS NOT NULL AND q.embedding IS NOT NULL THEN greatest(0, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))) ELSE 0 END AS dense
  FROM {q} q JOIN {at}_m m USING (item_id) CROSS JOIN ep e LEFT JOIN {at}_c c ON c.item_id = m.item_id AND c.doc_id = e.doc_id LEFT JOIN nt ON nt.doc_id = e.doc_id),
{at}_s AS (SELECT item_id, doc_id, age, round((3 * dense + 2 * cov + 0.5 * least(shared / greatest(terms, 1)::DOUBLE / 0.5, 1) + 0.4 * (1 - least(age / 24, 1)) + CASE WHEN anchor THEN 0.8 ELSE 0 END + CASE WHEN valued THEN 0.4 ELSE 0 END + CASE WHEN kind = asks THEN 1.4 WHEN kind <> asks THEN -0.6 ELSE 0 END
  + CASE WHEN cov > 1 - 1e-9 AND contains(body, needle) THEN 0.6 ELSE 0 END)::DOUBLE, 6) AS score FROM {at}_p WHERE shared > 0 OR (anchor AND kind = asks) OR dense >= 0.15),
{at} AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, age, doc_id) AS rank FROM {at}_s) WHERE rank <= {pool})"""


@query("episode_search", f"WITH {EP}, {_search('qs', 'a', POOL)} SELECT item_id, doc_id, score, rank FROM a")
def episode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each question with all parts of the score, in order."""
    return E.search(_episodes(spark, sf_dir), _questions(spark, sf_dir), POOL)


@query("episode_diverse")
def episode_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question is shown: none too alike, but all anchors. A brute-force twin is in the tests."""
    ep = _episodes(spark, sf_dir)
    return E.selected(E.search(ep, _questions(spark, sf_dir), POOL), ep, LIMIT)


_BRIDGE = f"""h AS (SELECT item_id, term, count(*) AS n FROM a JOIN dt USING (doc_id) WHERE rank <= 3 AND length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$') AND NOT EXISTS (SELECT 1 FROM a_t WHERE a_t.item_id = a.item_id AND a_t.term = dt.term) GROUP BY ALL),
b6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS k FROM h) WHERE k <= 6), q2 AS (SELECT item_id, string_agg(term, ' ' ORDER BY k) AS text, NULL::VARCHAR AS asks, NULL::FLOAT[] AS embedding FROM b6 GROUP BY 1)"""


@query("bridge_terms", f"WITH {EP}, {_search('qs', 'a', 3)}, {_BRIDGE} SELECT item_id, text FROM q2")
def bridge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep, q = _episodes(spark, sf_dir), _questions(spark, sf_dir)
    return E.bridges(E.search(ep, q, E.BRIDGE_FROM), ep, q)


@query("two_hop_search", f"""WITH {EP}, {_search('qs', 'a', LIMIT)}, {_BRIDGE}, {_search('q2', 'b', LIMIT)},
u AS (SELECT item_id, doc_id, min(struct_pack(t := turn, r := rank)) AS w FROM (SELECT item_id, doc_id, CASE WHEN rank <= 6 THEN 0 ELSE 2 END AS turn, rank FROM a UNION ALL SELECT item_id, doc_id, 1, rank FROM b) GROUP BY ALL)
SELECT item_id, doc_id, (CASE WHEN w.t = 1 THEN 2 ELSE 1 END)::INTEGER AS hop, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w, doc_id) AS rank FROM u) WHERE rank <= {LIMIT}""")
def two_hop_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits, and those that their own terms lead to."""
    from tidemark.sources.scratch import written

    ep, q = _episodes(spark, sf_dir), _questions(spark, sf_dir)
    first = written(E.search(ep, q, LIMIT), "hop1")
    again = E.bridges(first, ep, q).select("item_id", "text", F.lit(None).cast("string").alias("anchor_kind"), F.lit(None).cast("array<float>").alias("embedding"))
    return E.expanded(first, E.search(ep, again, LIMIT), LIMIT)
