"""Pairs of rows by the overlap of their word sets: blocks of rows against blocks of rows, common words counted for all pairs of two blocks at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 512  #: of a left block that are counted at once


def counted(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """left, right: id, w (distinct words). left_id, right_id, overlap of the pairs with that overlap at least; that of two empty sets is 0."""
    sets = [t["w"].combine_chunks() for t in (left, right)]
    sizes = [np.diff(np.asarray(s.offsets)).astype(np.int64) for s in sets]
    words = pa.chunked_array([s.flatten() for s in sets]).cast(pa.large_string()).combine_chunks().dictionary_encode()
    codes = np.asarray(words.indices).astype(np.int64)
    n_left, n_right = len(sizes[0]), len(sizes[1])
    split = int(sizes[0].sum())
    # the rows of the right block that have each word, one word behind the other
    order = np.argsort(codes[split:], kind="stable")
    holders = np.repeat(np.arange(n_right), sizes[1])[order]
    starts = np.searchsorted(codes[split:][order], np.arange(len(words.dictionary) + 1))
    at = np.concatenate([[0], np.cumsum(sizes[0])])
    ids = [np.asarray(t["id"].combine_chunks()) for t in (left, right)]
    out = []
    for low in range(0, n_left, ROWS):
        high = min(low + ROWS, n_left)
        shared = np.zeros((high - low, n_right), np.int64)
        for i in range(low, high):
            mine = [holders[starts[c] : starts[c + 1]] for c in codes[at[i] : at[i + 1]]]
            if mine:
                shared[i - low] = np.bincount(np.concatenate(mine), minlength=n_right)
        union = sizes[0][low:high, None] + sizes[1][None] - shared
        overlap = shared / np.maximum(union, 1)
        x, y = np.nonzero(overlap >= least)
        out.append(pa.table({"left_id": ids[0][low + x], "right_id": ids[1][y], "overlap": overlap[x, y]}))
    return pa.concat_tables(out) if out else pa.table({"left_id": pa.array([], pa.int64()), "right_id": pa.array([], pa.int64()), "overlap": pa.array([], pa.float64())})


def overlapping(left: DataFrame, right: DataFrame, scope: str, least: float) -> DataFrame:
    """left, right: scope, id, w (array of distinct words). left_id, right_id, overlap of all pairs of a scope whose words overlap that much (least > 0).

    Each scope is a grid of blocks, so that none gathers in one task; a row goes to the blocks of its line alone."""
    shares = max(4, math.isqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own, every = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    a = left.where(F.col(scope).isNotNull() & (F.size("w") > 0)).select(scope, own.alias("row"), every.alias("column"), "id", "w")
    b = right.where(F.col(scope).isNotNull() & (F.size("w") > 0)).select(scope, every.alias("row"), own.alias("column"), "id", "w")
    keys = (scope, "row", "column")
    a, b = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (a, b))  # two sides of one table need columns of their own
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: counted(x, y, least), "left_id long, right_id long, overlap double")
