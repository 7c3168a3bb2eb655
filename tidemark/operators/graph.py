"""Belief graph: neighbours, bounded paths, upserts and cascading deletion over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def undirected(edges: DataFrame) -> DataFrame:
    """edges: source, target. Both directions, without repeats and loops."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.select("source", "target").unionByName(back).where("source <> target").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    both = undirected(edges)
    return both.groupBy("source").agg(F.count("*").alias("degree"), F.min("target").alias("least"), F.max("target").alias("most"))


def distances(edges: DataFrame, start: str, max_nodes: int = 4) -> DataFrame:
    """node, hops from the start, as far as a path of max_nodes nodes leads. One join a hop on the frontier; nodes reached before
    are left out. Edges and frontiers are written, so that no hop repeats those before it."""
    both = written(undirected(edges), "edges")
    seen = written(both.sparkSession.createDataFrame([(start, 0)], "node string, hops int"), "hop")
    front = seen
    for hop in range(1, max_nodes):
        front = front.join(both, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = written(front.join(seen.select("node"), "node", "left_anti"), "hop")
        seen = seen.unionByName(front)
    return seen


def upsert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and new: node_key, node_type, properties (map), seq. Properties merge, later entries win; the latest type stays."""
    both = nodes.unionByName(new)
    entry = both.select("node_key", "node_type", "seq", F.explode_outer("properties").alias("k", "v"))
    last = entry.groupBy("node_key", "k").agg(F.max_by("v", "seq").alias("v"))
    merged = last.where("k is not null").groupBy("node_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return both.groupBy("node_key").agg(F.max_by("node_type", "seq").alias("node_type")).join(merged, "node_key", "left")


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: node. Edges that touch no deleted node."""
    return edges.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti")
