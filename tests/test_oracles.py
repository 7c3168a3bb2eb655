"""Every query of the engine that has SQL, against DuckDB on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import tidemark.plans  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else None if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    a = got.select(*columns).toArrow().to_pylist()
    b = want.select(*[f'"{c}"' for c in columns]).to_arrow_table().to_pylist()
    rows = lambda x: sorted(repr(tuple(plain(r[c]) for c in columns)) for r in x)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows_and_have_a_twin_in_python(spark, sf, name):
    assert QUERIES[name](spark, sf).toArrow().num_rows > 0
    assert name in {"greedy_clusters", "diverse_topk", "episode_diverse", "reconsolidate", "hash_embeddings"}  # see test_brute_force


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
