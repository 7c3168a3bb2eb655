"""Operator 7: language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders up to the n-gram's are mixed with weights that depend on the frequency bucket of
the context. The weights are learned by expectation-maximisation on a deleted part of the training documents, with counts
from the rest; its tokens enter as a histogram over (bucket, log-ratios of the estimates), so all of them take part and the
driver gets a table of bounded size. Scores then use the counts of the whole training part.

Words and n-grams are keyed by 64-bit hashes; counting goes through the exchange of blocks.py.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.blocks import NULL_ID, by_bucket, chain, n_buckets, pack, pack_counts, runs_by_bucket, texts_of, unpack, unpack_counts, word_hashes, write_blocks
from tidemark.llm.common import materialise

ORDER = 2  #: of the n-grams
BUCKETS = 24  #: of the context's frequency, by powers of two
STEP = 4  #: cells of the histogram to a factor of two
TRAIN, DELETED, HELD_OUT = 0, 1, 2
_BEGIN, _END = np.uint64(0x5BD1E995A1B2C3D4), np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def kind_of(doc_id: int) -> int:
    """Held out by the fold; one training document in eight belongs to the deleted part."""
    h = zlib.crc32(b"" if doc_id == NULL_ID else str(doc_id).encode())
    return HELD_OUT if h % 5 == 1 else DELETED if h // 5 % 8 == 3 else TRAIN


class Grams:
    """The n-grams of a block: for each order the distinct keys, ascending, and each token's place among them.

    Order 0 are the contexts of order 1: none. `context[k]` gives, for each token, the place of its (k-1)-gram context.
    """

    def __init__(self, texts: list[bytes], order: int) -> None:
        words, lens = word_hashes(texts)
        self.lens = lens + 1  # with the end
        ends = np.cumsum(self.lens)
        n = int(self.lens.sum())
        is_end = np.zeros(n, bool)
        is_end[ends - 1] = True
        h = np.empty(n, np.uint64)
        h[~is_end], h[is_end] = words, _END
        first = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
        self.keys, self.place, self.context = {}, {}, {}
        self.starts: dict[int, int] = {}  #: place of the context that only begin marks fill
        grams = chain(np.zeros(n, np.uint64), h)
        begin = chain(np.zeros(1, np.uint64), np.array([_BEGIN]))  # what stands before a document's first token
        for k in range(1, order + 1):
            if k > 1:  # the (k-1)-gram that ends before each token; at a document's start it holds begin marks
                before = np.empty(n, np.uint64)
                before[1:], before[first] = self._last[:-1], begin[0]
                self.context[k] = np.searchsorted(self.keys[k - 1], before)
                grams, begin = chain(before, h), chain(begin, np.array([_BEGIN]))
            extra = begin if k < order and n else np.zeros(0, np.uint64)
            self.keys[k], inverse = np.unique(np.concatenate([grams, extra]), return_inverse=True)
            self.place[k] = inverse[:n]
            self._last = grams
            if len(extra):
                self.starts[k] = int(inverse[n])


def _requests(order: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(texts_of(row)[1], order)
                weight = 0 if row["kind"] == HELD_OUT else 1
                out: dict[str, list] = {"bucket": [], "block": [], "gram": [], "deleted": [], "keys": [], "counts": []}
                for k in range(1, order + 1):
                    keys = grams.keys[k]
                    counts = weight * np.bincount(grams.place[k], minlength=len(keys))
                    if k in grams.starts:  # a document's begin is a context once
                        counts[grams.starts[k]] += weight * row["n_docs"]
                    for b, i, j in runs_by_bucket(keys, n):
                        for name, v in zip(out, (b, row["block"], k, row["kind"] == DELETED, pack(keys[i:j]), pack_counts(counts[i:j])), strict=True):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["gram"], pa.int32()), pa.array(out["deleted"], pa.bool_()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))

    return run


_ANSWER = pa.schema([("block", pa.int64()), ("gram", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])


def _answers(bucket: int, asked: list[dict]) -> Iterator[pa.RecordBatch]:
    """Adds up and answers every block with the counts of its keys, in the training part and in its deleted part."""
    begin = chain(np.zeros(1, np.uint64), np.array([_BEGIN]))[0]
    for gram in sorted({r["gram"] for r in asked}):
        rows = [(r["block"], r["deleted"], unpack(r["keys"]), unpack_counts(r["counts"], 1)[0]) for r in asked if r["gram"] == gram]
        keys, inverse = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        counts = np.concatenate([r[3] for r in rows])
        deleted = np.repeat([r[1] for r in rows], [len(r[2]) for r in rows])
        total = np.bincount(inverse, counts, len(keys)).astype(np.int64)
        apart = np.bincount(inverse, counts * deleted, len(keys)).astype(np.int64)
        at = 0
        for block, _, own, _ in rows:
            mine = inverse[at : at + len(own)]
            at += len(own)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, gram, bucket, pack_counts(total[mine], apart[mine]), 0, 0), _ANSWER, strict=True)], schema=_ANSWER)
        if gram == 1:  # the begin mark is no token
            real = keys != begin
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((-1, 1, bucket, None, int((total[real] > 0).sum()), int(total[real].sum())), _ANSWER, strict=True)], schema=_ANSWER)


class Counts:
    """A block's n-grams with the corpus counts that came back for them."""

    def __init__(self, block: pa.Table, answers: pa.Table, order: int) -> None:
        row = block.to_pylist()[0]
        self.ids, texts = texts_of(row)
        self.kind, self.grams, self.order = row["kind"], Grams(texts, order), order
        rows = sorted(answers.select(["gram", "bucket", "counts"]).to_pylist(), key=lambda r: (r["gram"], r["bucket"]))
        self.total, self.deleted = {}, {}
        for k in range(1, order + 1):
            got = [unpack_counts(r["counts"], 2) for r in rows if r["gram"] == k]
            self.total[k] = np.concatenate([*(g[0] for g in got), np.zeros(0, np.int64)])
            self.deleted[k] = np.concatenate([*(g[1] for g in got), np.zeros(0, np.int64)])
            assert len(self.total[k]) == len(self.grams.keys[k]), "answers are missing"

    def estimates(self, n: int, v: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each token's context, [order + 1, token] estimates, the uniform one first, and which of them there are).

        A context that was never seen has no estimate.
        """
        count = {k: self.total[k] if whole else self.total[k] - self.deleted[k] for k in self.total}
        g = self.grams
        p = np.zeros((self.order + 1, len(g.place[1])))
        there = np.ones(p.shape, bool)
        p[0] = 1 / (v + 1)
        there[1] = n > 0
        p[1] = count[1][g.place[1]] / max(n, 1)
        seen = np.full(p.shape[1], n)
        for k in range(2, self.order + 1):
            seen = count[k - 1][g.context[k]]
            there[k] = seen > 0
            p[k] = count[k][g.place[k]] / np.maximum(seen, 1)
        return np.minimum(np.log2(seen + 1).astype(np.int64), BUCKETS - 1), p, there


def mixed(lam: np.ndarray, p: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Interpolated probabilities. The weights of estimates that a context lacks go to its others, so that all words' sum to 1."""
    return (lam.T * p * there).sum(0) / (lam.T * there).sum(0)


def learn(cells: np.ndarray, weight: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights [bucket, component] by expectation-maximisation.

    cells: rows of (bucket, cell of each order's estimate: log2 ratio to the uniform one in STEPs, -1 for probability 0, -2 for
    a context that was never seen). A bucket with few tokens leans on the weights over all buckets.
    """
    ratio = np.where(cells[:, 1:] < 0, 0.0, 2.0 ** ((cells[:, 1:] - 64 + 0.5) / STEP))
    like = np.concatenate([np.ones((len(cells), 1)), ratio], 1)
    lack = np.concatenate([np.zeros((len(cells), 1)), cells[:, 1:] == -2], 1)

    def em(lam: np.ndarray, group: np.ndarray, prior: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            post = lam[group] * like
            post /= post.sum(1, keepdims=True)
            none = lam[group] * lack  # such a token says nothing of an estimate it lacks: that keeps its weight
            post = weight[:, None] * (post * (1 - none.sum(1, keepdims=True)) + none)
            sums = prior + np.stack([np.bincount(group, post[:, j], len(lam)) for j in range(order + 1)], 1)
            lam = sums / sums.sum(1, keepdims=True)
        return np.maximum(lam, 1e-7) / np.maximum(lam, 1e-7).sum(1, keepdims=True)

    start = np.full((1, order + 1), 1 / (order + 1))
    if not len(cells):
        return np.repeat(start, BUCKETS, 0)
    all_ = em(start, np.zeros(len(cells), np.int64), np.full((1, order + 1), 1e-3))
    return em(np.repeat(all_, BUCKETS, 0), cells[:, 0], 10 * np.repeat(all_, BUCKETS, 0))


def _cells(n: int, v: int, order: int):
    names = ["bucket", *[f"c{k}" for k in range(1, order + 1)]]

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, p, there = Counts(block, answers, order).estimates(n, v, whole=False)
        with np.errstate(divide="ignore"):
            cell = np.where(p[1:] > 0, np.clip(np.floor(STEP * np.log2(np.maximum(p[1:], 1e-300) / p[0])) + 64, 0, 400), np.where(there[1:], -1, -2)).astype(np.int64)
        rows, counts = np.unique(np.concatenate([bucket[None], cell]).T, axis=0, return_counts=True)
        return pa.table([*(pa.array(rows[:, j]) for j in range(order + 1)), pa.array(counts.astype(np.int64))], names=[*names, "n"])

    return run, names


def _with_replies(blocks: DataFrame, replies: DataFrame, run, schema: str) -> DataFrame:
    """Calls run(block, its replies) for each block."""

    def pair(block: pa.Table, answers: pa.Table) -> pa.Table:
        return run(block, answers) if block.num_rows else empty

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(pair, schema)


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of every row's whole text; see SCHEMA.

    A text's tokens are its words (runs of bytes other than space and \\x09-\\x0D, ASCII letters lowered) and one end. Null and
    empty texts have the end alone. Without training rows, counts are 0 and N is 0, and every token scores as unknown. Where a
    token's context was never seen, the weights of the estimates that are left are scaled to 1.
    """
    blocks = write_blocks(docs, kind_of)
    n_b = n_buckets(blocks)
    asked = blocks.mapInArrow(_requests(order, n_b), "bucket int, block long, gram int, deleted boolean, keys binary, counts binary")
    answers = materialise(by_bucket(asked, n_b, _answers, "block long, gram int, bucket int, counts binary, distinct long, total long"), "answers")
    sums = answers.where("block = -1").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    v, n = int(sums.v or 0), int(sums.n or 0)
    replies = answers.where("block >= 0").select("block", "gram", "bucket", "counts")
    part, names = _cells(n, v, order)
    cells = _with_replies(blocks.where(f"kind = {DELETED}"), replies, part, ", ".join(f"{c} long" for c in [*names, "n"]))
    grid = np.array([list(r) for r in cells.groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).collect()], np.int64).reshape(-1, order + 2)
    lam = learn(grid[:, :-1], grid[:, -1].astype(float), order)

    def scores(block: pa.Table, reply: pa.Table) -> pa.Table:
        counts = Counts(block, reply, order)
        g = counts.grams
        bucket, p, there = counts.estimates(n, v, whole=True)
        c = counts.total[1][g.place[1]]
        first = np.concatenate([[0], np.cumsum(g.lens)[:-1]])
        add = lambda x: np.add.reduceat(x, first)
        base = add(np.log10((c + 0.5) / (n + 0.5 * (v + 1))))
        score = add(np.log10(mixed(lam[bucket], p, there)))
        rows = {"doc_id": pa.array(counts.ids, mask=counts.ids == NULL_ID), "held_out": [counts.kind == HELD_OUT] * len(g.lens), "n_tokens": g.lens, "n_known": add((c > 0).astype(np.int64)), "train_tokens": np.full(len(g.lens), n), "base_score": base, "score": score}
        return pa.table([pa.array(rows[f.name], f.type) if not isinstance(rows[f.name], pa.Array) else rows[f.name] for f in _OUT], schema=_OUT)

    return _with_replies(blocks, replies, scores, SCHEMA)
