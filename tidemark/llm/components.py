"""Connected components of a graph given as an edge table: union-find in one task for a bounded number of edges, alternating
star contractions beyond it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import joined, materialise


IN_ONE_TASK = 1 << 20  #: edges (16 MB) that one task takes in; more go through distributed rounds


def components(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """edges: a, b (longs, neither null). node, comp: each node of an edge with the smallest node it is connected with.

    Up to in_one_task edges, one task joins them in a union-find, which saves the rounds' many small stages. Beyond, large stars hang a node's larger neighbours on its smallest one, small stars its smaller ones; both only re-hang edges, so
    the number of edges stays linear, and a logarithmic number of rounds suffices. Hubs are broadcast, not shuffled on. Each round is written to the shared folder;
    only a count and a checksum come to the driver.
    """
    if edges.count() <= in_one_task:
        return materialise(edges.where("a <> b").coalesce(1).mapInArrow(_union_find, "node long, comp long"), "components")
    now = materialise(_pairs(edges), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined(both.where("b > a"), least, "a", "n", 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(_pairs(large), "edges")  # a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(large, low, "a", "n", mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialise(_pairs(small.unionByName(low.select("a", F.col("m").alias("b")))), "edges")
        mark, old = _mark(new), mark
        if mark == old:
            break
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()], 1) for b in batches if b.num_rows]
    if pairs:
        nodes, at = np.unique(np.concatenate(pairs), return_inverse=True)
        at = at.reshape(-1, 2)
        root = np.arange(len(nodes))
        while True:  # hang every root on the smallest neighbour's root, then flatten; nodes are in ascending order
            low = np.minimum(root[at[:, 0]], root[at[:, 1]])
            new = root.copy()
            np.minimum.at(new, root[at[:, 0]], low)
            np.minimum.at(new, root[at[:, 1]], low)
            while (new != new[new]).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "comp"])


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first())
