"""Operator 4: mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each source has a target share of the mixture; with its size known, that fixes the mean number of times each of its
documents is repeated. A document's count is drawn by inverting the Poisson distribution of that mean at a uniform number
taken from a seeded hash of its identity, so the draw is the same on every run and needs no state. Documents are exploded by their
count and dealt out by another hash, which shuffles the mixture globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gathered, joined, materialise, partitions_for

NO_SOURCE = "∅"  #: stands for a null source among the weights
RATE = 512.0  #: mean of one draw at most; a larger one is the sum of equal draws, as exp(-rate) would vanish
COPIES = 4096  #: copies of a row that one array numbers
SOURCES = 2048  #: sources, counted, whose tables (6 kB each at most) are broadcast


def uniform(seed: int, *parts: Column) -> Column:
    """A number from [0, 1) with 52 bits, from the md5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds cdf, the cumulative Poisson probabilities of `rate` up to ten standard deviations and ten above it.

    Beyond that bound less than 1e-15 of the probability remains, under the resolution of the uniform number.
    """
    k = F.sequence(F.lit(1), F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 10).cast("int"))
    first = F.exp(-F.col("rate"))
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * F.col("rate") / i
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return rates.withColumn("cdf", F.aggregate(k, start, step)["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, most: float | None) -> DataFrame:
    """source, n_docs, rate: the mean repetitions of each source's documents.

    weights: relative target of each source (None: all alike); sources that aren't named get none. total: documents of the
    mixture (None: as many as there are). most: if given, no document of a source is repeated more often than this on
    average, and what a small source so falls short of isn't given to others.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("mix_source")
    sizes = docs.select(source).groupBy("mix_source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        sizes = sizes.withColumn("weight", F.coalesce(named[F.col("mix_source")], F.lit(0.0)) if weights else F.lit(0.0))
    all_weight, all_docs = sizes.agg(F.sum("weight")).scalar(), sizes.agg(F.sum("n_docs")).scalar()
    wanted = all_docs.cast("double") if total is None else F.lit(float(total))
    rate = F.when(all_weight > 0, F.col("weight") / all_weight * wanted / F.col("n_docs")).otherwise(0.0)
    rate = rate if most is None else F.least(F.lit(float(most)), rate)
    return sizes.select("mix_source", "n_docs", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, most: float | None = None, seed: int = 20, copy_column: str | None = "copy_no", order_column: str | None = "mix_key") -> DataFrame:
    """Every column of docs, each row as often as drawn, in a globally shuffled order.

    copy_column numbers a row's copies from 1, order_column is the hash by which copies are shuffled: within a partition rows
    ascend by it, and a copy's partition is drawn by it too. Columns of docs of the same names are replaced. A null source is
    a source of its own. Rows that repeat a doc_id and text draw the same count. An empty table stays empty.
    """
    columns = [c for c in docs.columns if c not in (copy_column, order_column)]
    rates = materialise(gathered(source_rates(docs, weights, total, most)), "rates").withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE)).cast("int"))
    table = poisson_table(rates.withColumn("rate", F.col("rate") / F.col("draws"))).select("mix_source", "n_docs", "draws", "cdf")
    name = {c: f"__{i}" for i, c in enumerate(columns)}  # so that they can't clash with the columns added here
    kept, doc_id, source = list(name.values()), F.col(name["doc_id"]), F.col(name["source"])
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in name.items()])
    rows = rows.select("*", F.coalesce(source.cast("string"), F.lit(NO_SOURCE)).alias("mix_source"), uniform(seed, doc_id, source).alias("u"))
    count = lambda u: F.size(F.filter("cdf", lambda c: c <= u)).cast("long")  # noqa: E731 - the least k with u < cdf(k)
    again = lambda n, i: n + count(uniform(seed, doc_id, source, i))
    more = F.when(F.col("draws") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), "draws")), F.lit(0).cast("long"), again)).otherwise(0)
    met = rows.join(F.broadcast(table), "mix_source") if rates.count() <= SOURCES else joined(rows, table, "mix_source", "n_docs", docs.count())
    drawn = met.select(*kept, (count(F.col("u")) + more).alias("n")).where("n > 0")
    runs = drawn.select(*kept, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(COPIES).cast("long"))).alias("__first"))
    copies = runs.select(*kept, F.explode(F.sequence("__first", F.least("n", F.col("__first") + (COPIES - 1)))).alias("__copy"))
    keyed = copies.withColumn("__copy", F.col("__copy").cast("int")).withColumn("__key", uniform(seed + 1, doc_id, source, F.col("__copy")))
    parts = partitions_for(docs.sparkSession)
    shuffled = keyed.repartition(parts, "__key").sortWithinPartitions("__key", doc_id, "__copy")
    extra = [F.col(a).alias(b) for a, b in (("__copy", copy_column), ("__key", order_column)) if b]
    return shuffled.select(*[F.col(a).alias(c) for c, a in name.items()], *extra)


ORACLE_SQL = """
WITH RECURSIVE sizes AS (SELECT coalesce(source, '∅') AS s, count(*) AS n FROM documents GROUP BY 1),
wanted AS (SELECT s, (1.0::DOUBLE / (SELECT count(*) FROM sizes)) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS r FROM sizes),
rates AS (SELECT s, greatest(1, ceil(r / 512))::INTEGER AS draws, r / greatest(1, ceil(r / 512))::INTEGER AS r FROM wanted),
cdf AS (
  SELECT s, r, draws, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM rates
  UNION ALL SELECT s, r, draws, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE k < ceil(r + 10 * sqrt(r) + 10)),
tables AS (SELECT s, any_value(draws) AS draws, list(c ORDER BY k) AS cdf FROM cdf GROUP BY s),
numbered AS (
  SELECT d.*, t.cdf, coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') AS ident, unnest(range(1, t.draws + 1)) AS draw
  FROM (SELECT *, row_number() OVER () AS rn FROM documents) d JOIN tables t ON t.s = coalesce(d.source, '∅')),
counted AS (
  SELECT * EXCLUDE (cdf), len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('20|' || ident || CASE WHEN draw > 1 THEN '|' || draw::VARCHAR ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS times
  FROM numbered),
drawn AS (SELECT rn, doc_id, text, lang, source, n_chars, ident, sum(times)::BIGINT AS times FROM counted GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
  ('0x' || substr(md5('21|' || ident || '|' || copy_no::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS mix_key
FROM (SELECT * FROM drawn WHERE times > 0) x, unnest(range(1, times + 1)) AS u(copy_no)
"""
