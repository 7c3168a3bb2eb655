"""Selection from ranked candidates: unions, diversity, packing, clusters; and embedding of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.matching import ranked


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def candidate_union(stages: list[DataFrame], key: str, most: int) -> DataFrame:
    """Rows of all stages (each: key, pos), an earlier stage's first, without repeats, cut to `most` in that order."""
    both = None
    for i, s in enumerate(stages):
        rows = s.select(key, F.lit(i).alias("stage"), F.col("pos").cast("long").alias("pos"))
        both = rows if both is None else both.unionByName(rows)
    first = both.groupBy(key).agg(F.min(F.struct("stage", "pos")).alias("at")).select(key, "at.stage", "at.pos")
    return first.orderBy("stage", "pos", key).limit(most)


def diverse(rows: DataFrame, by: str, top: int, most_alike: float = 0.8) -> DataFrame:
    """rows: by, doc_id, score, terms (array), optionally exempt. Greedy selection in descending score: a row too alike to a chosen
    one is passed over, unless it is exempt or has no terms.

    Order-dependent, so each group is folded in order, in the JVM; groups are a query's candidates, cut before this to a bounded
    number. The chosen rows' term sets are all the fold holds.
    """
    exempt = F.coalesce(F.col("exempt"), F.lit(False)) if "exempt" in rows.columns else F.lit(False)
    line = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "score", exempt.alias("exempt"), "terms")))
    none = F.array().cast("array<struct<doc_id bigint, score double, terms array<string>>>")

    def step(chosen: Column, x: Column) -> Column:
        alike = F.exists(chosen, lambda c: (F.size(F.array_union(c["terms"], x["terms"])) > 0) & (F.size(F.array_intersect(c["terms"], x["terms"])) > most_alike * F.size(F.array_union(c["terms"], x["terms"]))))
        take = (F.size(chosen) < top) & (x["exempt"] | (F.size(x["terms"]) == 0) | ~alike)
        return F.when(take, F.array_append(chosen, F.struct(x["doc_id"].cast("bigint").alias("doc_id"), x["score"].cast("double").alias("score"), x["terms"].alias("terms")))).otherwise(chosen)

    got = rows.groupBy(by).agg(line.alias("line")).select(by, F.posexplode(F.aggregate("line", none, step)).alias("pos", "c"))
    return got.select(by, "c.doc_id", "c.score", (F.col("pos") + 1).cast("bigint").alias("rank"))


def packed(blocks: DataFrame, by: str, budget: int) -> DataFrame:
    """blocks: by, block_id, content_hash, tokens, score. Greedy packing under a token budget: in descending score, then ascending size,
    a block that doesn't fit or repeats a hash is passed over. One fold over a sorted array, in the JVM."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("tokens"), F.col("block_id"), F.col("content_hash"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<long>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~F.array_contains(acc["seen"], x["content_hash"]) & (acc["used"] + x["tokens"] <= budget)
        return F.struct(
            F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["seen"], x["content_hash"])).otherwise(acc["seen"]).alias("seen"),
            F.when(fits, F.array_append(acc["ids"], x["block_id"])).otherwise(acc["ids"]).alias("ids"))

    done = blocks.groupBy(by).agg(order.alias("line"), F.sum("tokens").alias("naive")).withColumn("p", F.aggregate("line", start, step))
    return done.select(by, F.col("p.used").alias("used"), F.size("p.ids").alias("blocks"), "naive", F.array_join(F.col("p.ids").cast("array<string>"), ",").alias("ids"))


def greedy_clusters(vectors: DataFrame, by: str, tau: float, least: int = 3, most: int = 8, limit: int = 2000, used: DataFrame | None = None) -> DataFrame:
    """vectors: by, vec_id, embedding. Single-pass clustering in ascending vec_id within each group: a seed takes the free vectors of
    cosine tau or more, earlier ones included, up to `most` members; clusters under `least` are dropped and leave their members free.

    A call takes the first `limit` vectors of a group that aren't used (vec_id) yet: that is the operator's budget, and what a task
    holds. Once they are consolidated, the next call takes those that follow.
    """
    import numpy as np

    if used is not None:
        vectors = vectors.join(used.select("vec_id"), "vec_id", "left_anti")
    first = ranked(vectors, by, ["vec_id"], limit).drop("rank")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        ids = g["vec_id"].to_numpy()
        m = np.stack([np.asarray(v, float) for v in g["embedding"]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        free, out = np.ones(len(ids), bool), []
        for i in range(len(ids)):
            if free[i]:
                near = np.flatnonzero((m @ m[i] >= tau) & free)
                near = np.concatenate([[i], near[near != i]])[:most]
                if len(near) >= least:
                    free[near] = False
                    out += [(g[by].iloc[0], ids[i], ids[j]) for j in near]
        return pd.DataFrame(out, columns=[by, "seed", "vec_id"])

    return first.groupBy(by).applyInPandas(fold, f"{by} int, seed long, vec_id long")


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Adds embedding by an injected function of text batches; equal texts are embedded once."""
    texts = docs.select("text").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["embedding"] = embedder(b["text"].fillna("").tolist())
            yield b

    return docs.join(texts.mapInPandas(run, "text string, embedding array<float>"), "text")


def hash_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Unit vectors from chained sha256 digests: equal texts agree, others are unrelated."""
    import hashlib

    import numpy as np

    out = []
    for t in texts:
        raw, seed = b"", t.encode()
        while len(raw) < dims:
            seed = hashlib.sha256(seed).digest()
            raw += seed
        v = np.frombuffer(raw[:dims], np.uint8).astype(float) / 127.5 - 1
        out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
    return out
