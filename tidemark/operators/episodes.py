"""Episode search: dense, lexical, recency, anchor and exact parts; a diverse selection; and a second hop over bridge terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import matching as M
from tidemark.operators.retrieval import diverse

# fixed values: weights and gates
DENSE, COVERAGE, FOCUS, RECENCY, EXACT, MIN_DENSE, DEDUP = 3.0, 2.0, 0.5, 0.4, 0.6, 0.15, 0.8
ANCHOR, ANCHOR_VALUE, ANCHOR_KIND, OTHER_KIND = 0.8, 0.4, 1.4, -0.6
BRIDGE_FROM, BRIDGE_TERMS, BRIDGE_LENGTH = 3, 6, 4
COLUMNS = ("doc_id", "age_hours", "is_anchor", "anchor_kind", "anchor_value", "embedding")


def search(episodes: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """item_id, doc_id, score, rank: the best `pool` episodes of each query; ties go to the younger, then the smaller doc_id.

    episodes: COLUMNS and text. queries: item_id, text, anchor_kind (null: none), embedding (null: none). An episode is a candidate if
    it shares a term, is an anchor of the kind asked for, or its cosine reaches MIN_DENSE. The exact part goes to episodes that hold
    the query's text.
    """
    folded = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    rows, out = M.tokenised(M.dealt(episodes).withColumn("folded", folded("text")), *COLUMNS, "folded"), []
    schema = "item_id long, doc_id long, score double, age_hours double"
    for terms in M.passes(queries):
        n, _, df = M.corpus(rows, terms)
        idf = np.log(1 + n / (1 + df))
        asked = queries.select("item_id", folded("text").alias("folded"), "anchor_kind", "embedding").toArrow()
        place = {i: k for k, i in enumerate(asked.column("item_id").to_pylist())}
        asked = asked.take([place[i] for i in terms.items.tolist()]).combine_chunks()
        vectors = asked.column("embedding")
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        dims = int(max(np.diff(vectors.offsets.to_numpy()), default=0))
        kinds = {k: i for i, k in enumerate(sorted({x for x in asked.column("anchor_kind").to_pylist() if x}))}
        wanted = np.array([kinds.get(k, M.ALL) for k in asked.column("anchor_kind").to_pylist()])
        sent = rows.sparkSession.sparkContext.broadcast((idf, asked.column("folded").to_pylist(), kinds, wanted, *M.unit(vectors, dims), dims))

        def emit(block: M.Block, terms: M.Terms, sent=sent) -> Iterator[pa.RecordBatch]:
            idf, texts, kinds, wanted, q, has, dims = sent.value
            b, value = block.batch, idf[terms.word]
            ids, age = b.column("doc_id").to_numpy(), b.column("age_hours").to_numpy()
            anchor, valued = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_anchor", "anchor_value"))
            kind, body = M.numbered(b.column("anchor_kind"), kinds), b.column("folded").to_pylist()
            there, (m, vector) = (block.tf > 0).astype(float), M.unit(b.column("embedding"), dims)
            mass = np.bincount(terms.item, value, len(terms.items))
            for low, high in M.spans(block, len(terms.items)):
                covered = there @ terms.matrix(low, high, value) / mass[None, low:high]
                shared = there @ terms.matrix(low, high, np.ones(len(terms.item)))
                dense = np.maximum(m @ q[low:high].T, 0) * (vector[:, None] & has[None, low:high])
                asks = wanted[None, low:high]
                same = (kind[:, None] == asks) & (asks != M.ALL)
                other = (asks != M.ALL) & (kind[:, None] != M.ALL) & ~same
                score = DENSE * dense + COVERAGE * covered + FOCUS * np.minimum(shared / np.maximum(block.distinct, 1)[:, None] / 0.5, 1)
                score += (RECENCY * (1 - np.minimum(age / 24, 1)) + ANCHOR * anchor + ANCHOR_VALUE * valued)[:, None] + ANCHOR_KIND * same + OTHER_KIND * other
                for i, k in zip(*np.nonzero(covered > 1 - 1e-9), strict=True):  # only such can hold the query's text
                    score[i, k] += EXACT if texts[low + k] in body[i] else 0
                may = (shared > 0) | (same & anchor[:, None]) | (dense >= MIN_DENSE)
                score = np.round(score, 6)
                row, query = M.best([score, -age, -ids], may, pool)
                yield pa.RecordBatch.from_arrays([pa.array(terms.items[low + query]), pa.array(ids[row]), pa.array(score[row, query]), pa.array(age[row])], names=["item_id", "doc_id", "score", "age_hours"])

        out.append(M.over(rows, terms, emit, schema))
    found = M.united(out, rows.sparkSession.createDataFrame([], schema))
    return M.ranked(found, "item_id", [F.desc("score"), "age_hours", "doc_id"], pool).drop("age_hours")


def selected(found: DataFrame, episodes: DataFrame, limit: int) -> DataFrame:
    """Of each query's pool the diverse top: item_id, doc_id, score, rank. Anchors are never passed over as too alike."""
    terms = episodes.select("doc_id", F.col("is_anchor").alias("exempt"), F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    return diverse(found.drop("rank").join(terms, "doc_id"), "item_id", limit, DEDUP)


def bridges(found: DataFrame, episodes: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, text: the terms in most of a query's first hits that it doesn't have itself, as the query of a second hop."""
    own = queries.select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("own"))
    hits = found.where(F.col("rank") <= BRIDGE_FROM).join(episodes.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms")), "doc_id").join(own, "item_id")
    new = hits.select("item_id", F.explode(F.array_except("terms", "own")).alias("term")).where((F.length("term") >= BRIDGE_LENGTH) & ~F.col("term").rlike(r"^\d+$"))
    counts = new.groupBy("item_id", "term").agg(F.count("*").alias("n"))
    top = M.ranked(counts, "item_id", [F.desc("n"), "term"], BRIDGE_TERMS)
    return top.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("text"))


def expanded(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Both hops' ranked hits in one list: item_id, doc_id, hop, rank. The second hop has a reserve of a third, two at least; what
    it leaves goes to the first again; a document counts once."""
    reserve = max(2, limit // 3)
    a = first.select("item_id", "doc_id", F.when(F.col("rank") <= limit - reserve, 0).otherwise(2).alias("turn"), "rank")
    b = second.select("item_id", "doc_id", F.lit(1).alias("turn"), "rank")
    one = a.unionByName(b).groupBy("item_id", "doc_id").agg(F.min(F.struct("turn", "rank")).alias("at"))
    w = Window.partitionBy("item_id").orderBy("at", "doc_id")
    return one.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit).select("item_id", "doc_id", F.when(F.col("at.turn") == 1, 2).otherwise(1).alias("hop"), "rank")
