"""Operator 10: toxicity scores by a counterfactually regularised linear classifier.

Features are the presence of words and of word beginnings (so that inflected and compounded forms count). A screen by
log-odds keeps those that tell the classes apart. The weights minimise the logistic loss plus a penalty on the squared change
of the score when identity terms in a labelled text are swapped for others, so that a neutral mention of a group says nothing.
Training reads a bounded sample (SAMPLE rows, those of the smallest hash); scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LONG_WORD, arrow, documents, fold, lower_ascii, slices

SAMPLE = 8_000  #: labelled rows used for training, at most
FEATURES = 8192  #: features kept by the screen, at most
BITS = 22
MEMO = 250_000
# Groups of terms that may stand for each other in a neutral sentence.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "disabled", "deaf", "blind"),
)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_TRIM = b".,;:!?\"'()[]{}<>*_-"


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashes of a lower-cased word without its outer punctuation: the word itself and its beginnings of 4, 5 and 6 bytes."""
    w = word.strip(_TRIM)
    if not w:
        return ()
    mask = (1 << BITS) - 1
    return tuple([zlib.crc32(b"=" + w) & mask] + [zlib.crc32(b"^" + w[:k]) & mask for k in (4, 5, 6) if len(w) >= k])


def words_of(text: bytes) -> set[bytes]:
    return set(lower_ascii(text).split())


def swaps(words: set[bytes]) -> list[set[bytes]]:
    """The text's word set with each of its identity terms exchanged for each other one of the group."""
    out = []
    for group in IDENTITY:
        terms = [t.encode() for t in group]
        for t in terms:
            if t in words:
                out += [(words - {t}) | {other} for other in terms if other != t and other not in words]
    return out


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def score(self, present: set[int]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(present))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _row(words: set[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in words for f in features_of(w)), np.uint32))


def train(texts: list[bytes], toxic: np.ndarray, penalty: float = 1.0) -> Model:
    """Fits the model to texts."""
    words = [words_of(t) for t in texts]
    return train_rows([_row(w) for w in words], [[_row(s) for s in swaps(w)] for w in words], toxic, penalty)


def train_rows(rows: list[np.ndarray], swapped: list[list[np.ndarray]], toxic: np.ndarray, penalty: float = 1.0, decay: float = 0.02, steps: int = 300) -> Model:
    """Fits the model to the features of texts and of their swapped copies. With one class only, or nothing to learn from,
    every score is that class's smoothed share."""
    y = np.asarray(toxic, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(bias, {})
    pairs = [(i, s) for i, some in enumerate(swapped) for s in some]
    n = 1 << BITS
    p, q = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for r, one in zip(rows, y, strict=True):
        (p if one else q)[r] += 1  # a row's features are distinct
    np_, nq = (y == 1).sum(), (y == 0).sum()
    z = np.zeros(n, np.float32)
    some = np.flatnonzero(p + q)
    p, q = p[some], q[some]
    z[some] = (np.log((p + 0.5) / (np_ - p + 0.5)) - np.log((q + 0.5) / (nq - q + 0.5))) / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    many = np.zeros(n, bool)
    many[some] = p >= 2
    sure = np.flatnonzero((many & (z > 2.5)) | (z < -5))
    chosen = np.sort(sure[np.argsort(-np.abs(z[sure]), kind="stable")[:FEATURES]])
    if not len(chosen):
        return Model(bias, {})
    place = np.full(n, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [c[c >= 0] for c in (place[r] for r in rows)]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate([*cols, np.zeros(0, np.int32)])

    ri, ci = matrix(rows)
    si, sj = matrix([r for _, r in pairs])
    base = np.array([i for i, _ in pairs], np.int64)
    k, w, b = len(chosen), np.zeros(len(chosen)), bias
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        zed = b + np.bincount(ri, w[ci], len(y))
        prob = 1 / (1 + np.exp(-zed))
        err = (prob - y) / len(y)
        if len(base):  # squared change of the score between a text and its swapped copies
            other = b + np.bincount(si, w[sj], len(base))
            gap = 2 * penalty * (other - zed[base]) / len(base)
            back = np.bincount(sj, gap[si], k)
            err = err - np.bincount(base, gap, len(y))
        else:
            back, gap = 0.0, np.zeros(1)
        g = np.append(np.bincount(ci, err[ri], k) + back + decay * w / len(y), err.sum() + gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:k], b - step[k]
    return Model(float(b), {int(c): float(x) for c, x in zip(chosen, w, strict=True)})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on at most `sample` labelled rows: those of the smallest hash among rows whose fold isn't held out. Tasks turn
    their texts into features, four bytes each; those alone go to the driver."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").where(fold(4) != 2)
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("own", pa.binary()), ("swapped", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words = [words_of(t) for t in texts]
                yield arrow({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "own": [_row(w).tobytes() for w in words], "swapped": [[_row(s).tobytes() for s in swaps(w)] for w in words]}, out)

    rows = documents(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")
    got = rows.mapInArrow(run, "doc_id long, toxic int, own binary, swapped array<binary>").orderBy("doc_id", "own").limit(sample).toArrow()  # rows may share a doc_id
    features = lambda b: np.frombuffer(b, np.uint32)
    return train_rows([features(b) for b in got.column("own").to_pylist()], [[features(b) for b in some] for some in got.column("swapped").to_pylist()], np.array(got.column("toxic").to_pylist(), int))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of each row's whole text.

    Labels with a null toxic are left out; of several labels of a document the highest counts. Null and empty texts get the
    score of a text without features.
    """
    model = fit(docs, labels, sample)
    return scored(docs, model, threshold)


class Scorer:
    """Scores texts with a model; features of words met before are remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}

    def __call__(self, texts: list[bytes]) -> list[float]:
        memo, weights, out = self.memo, self.model.weights, []
        for t in texts:
            present: set[int] = set()
            for w in words_of(t):
                got = memo.get(w)
                if got is None:
                    got = tuple(f for f in features_of(w) if f in weights)
                    if len(w) <= LONG_WORD:
                        memo[w] = got
                if got:
                    present.update(got)
            out.append(self.model.score(present))
        if len(memo) > MEMO:
            memo.clear()
        return out


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in slices(batch):
                scores = scorer(texts)
                yield arrow({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": scores, "predicted": [int(s >= threshold) for s in scores]}, _OUT)

    rows = documents(docs, "doc_id", "text").withColumn("held_out", fold(4) == 2)
    return rows.mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all columns, that score under the threshold. Null and empty texts have no toxic feature."""
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in slices(batch):
                yield part.filter(pa.array(np.array(scorer(texts)) < threshold))

    return docs.mapInArrow(run, docs.schema)
