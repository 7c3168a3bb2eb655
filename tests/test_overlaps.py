"""Pairs by the overlap of their words, against sets in Python."""

from __future__ import annotations

import random

import pyarrow as pa

from tidemark.operators.overlaps import overlapping


def test_all_pairs_without_a_join_of_rows(spark):
    rng = random.Random(5)
    rows = lambda: [(rng.choice(["a", "b", None]), i, None if i == 7 else sorted({f"w{rng.randrange(60)}" for _ in range(rng.randrange(12))})) for i in range(60)]
    left, right = rows(), rows()
    ddl = "scope string, id long, w array<string>"
    got = overlapping(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), "scope", 0.1)
    want = {(i, j, len({*v} & {*w}) / len({*v} | {*w})) for s, i, v in left for t, j, w in right if s and s == t and v and w and len({*v} & {*w}) / len({*v} | {*w}) >= 0.1}
    assert {tuple(r) for r in got.collect()} == want and want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_counted_takes_blocks_of_many_rows():
    from tidemark.operators.overlaps import counted

    block = lambda n: pa.table({"id": pa.array(range(n), pa.int64()), "w": pa.array([["x", f"y{i}"] for i in range(n)], pa.list_(pa.string()))})
    assert counted(block(1100), block(3), 0.3).num_rows == 3300
    assert counted(block(0), block(3), 0.3).num_rows == 0
