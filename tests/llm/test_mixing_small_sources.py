"""Mixing at its production setting where sources are skewed, and against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.llm import mixing


def skewed(spark, few):
    big = spark.range(12_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('big', id % 3) AS source")
    return big.unionByName(spark.range(few).selectExpr("20000 + id AS doc_id", "concat('s', id) AS text", "'small' AS source"))


@pytest.mark.parametrize("few", [30, 2])
def test_small_sources_reach_their_share(spark, few):
    """3000 copies of each source: a rate of 100 for 30 documents, 1500 (several draws) for 2."""
    out = mixing.mix(skewed(spark, few)).select("doc_id", "source", "copy_no").collect()
    n = {s: sum(r.source == s for r in out) for s in ("big0", "big1", "big2", "small")}
    assert all(abs(x - 3000) < 300 for x in n.values()), n
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r.copy_no)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by_doc.values())
    small = [len(c) for i, c in by_doc.items() if i >= 20_000]
    assert len(small) == few and len(set(small)) > 1


def test_many_draws_have_the_mean_and_variance_of_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RATE", 7.0)
    monkeypatch.setattr(mixing, "COPIES", 5)
    docs = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    n = [r["count"] for r in mixing.mix(docs, total=40_000.0).groupBy("doc_id").count().collect()]
    mean = sum(n) / 2000
    assert len(n) == 2000 and abs(mean - 20) < 0.5 and abs(sum((x - mean) ** 2 for x in n) / 2000 - 20) < 3


def test_cap_on_request(spark):
    assert 40 < mixing.mix(skewed(spark, 30), most=2.0).where("source = 'small'").count() < 85


def test_same_rows_as_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    columns = ["doc_id", "source", "copy_no", "mix_key"]
    got = mixing.mix(spark.read.parquet(path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL})").fetchall(), key=repr)
