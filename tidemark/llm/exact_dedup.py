"""Operator 6: exact deduplication with a log-structured merge index over text digests.

Each task keeps a memtable of digests (smallest identifier, number of rows), flushes it as a sorted run with a Bloom filter,
and compacts its runs; what is left goes to the digest's own partition, where the runs of all tasks are sorted by digest and
merged in a stream. A digest of more than one row is a hit: the texts of hits alone are read again and compared byte by byte, by
grouping on digest and text with partial sums in each task. Digests of many rows are broadcast, not shuffled on, so a group of
any size never meets in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FEW, documents, gathered, joined, materialise, partitions_for

MEMTABLE = 1 << 15  #: rows of a memtable before it is flushed as a run
FANOUT = 6  #: runs that are compacted into one
EMIT = 1 << 20  #: entries a task holds before it passes them on
_NULL = np.iinfo(np.int64).max  # a null doc_id counts as the largest
INDEX_SCHEMA = "digest binary, keep_id long, ties long, group_size long"
_INDEX = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("ties", pa.int64()), ("group_size", pa.int64())])


def folded(digests: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests, ascending, each with its entries in one."""
    order = np.argsort(digests, kind="stable")
    digests, rows = digests[order], rows[order]
    new = np.append(True, digests[1:] != digests[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    keep = np.minimum.reduceat(rows[:, 0], first)
    ties = np.add.reduceat(np.where(rows[:, 0] == keep[group], rows[:, 1], 0), first)
    return digests[first], np.stack([keep, ties, np.add.reduceat(rows[:, 2], first)], 1)


class Run:
    """Sorted digests with identifiers, counts and a filter of ten bits a digest."""

    def __init__(self, digests: np.ndarray, rows: np.ndarray) -> None:
        self.digests, self.rows = folded(digests, rows)
        self.bits = max(64, 10 * len(self.digests))
        self.filter = np.zeros(self.bits, bool)
        for place in self.places(self.digests):
            self.filter[place] = True

    def places(self, digests: np.ndarray) -> list[np.ndarray]:
        raw = digests.view(np.uint8).reshape(len(digests), -1)
        wide = np.zeros((len(digests), 16), np.uint8)
        wide[:, : min(16, raw.shape[1])] = raw[:, :16]
        a, b = np.ascontiguousarray(wide).view(np.uint64).T
        return [((a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(self.bits)).astype(np.int64) for i in range(4)]

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Position of each digest in the run, -1 where it has none. The filter is asked first."""
        out = np.full(len(digests), -1, np.int64)
        maybe = np.flatnonzero(np.logical_and.reduce([self.filter[p] for p in self.places(digests)]))
        at = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
        hit = self.digests[at] == digests[maybe]
        out[maybe[hit]] = at[hit]
        return out


class LsmIndex:
    """Digest -> (smallest identifier, rows of that identifier, rows in all)."""

    def __init__(self, width: int, memtable: int = MEMTABLE, fanout: int = FANOUT) -> None:
        self.width, self.limit, self.fanout = width, memtable, fanout
        self.memory: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.runs, self.hits = 0, [], 0

    def __len__(self) -> int:
        return self.held + sum(len(r.digests) for r in self.runs)

    def add(self, digests: np.ndarray, rows: np.ndarray) -> None:
        """rows: identifier, rows of it, rows in all."""
        for run in self.runs:  # a digest that an older run has is merged there at once
            at = run.find(digests) if len(digests) else np.zeros(0, np.int64)
            known = at >= 0
            if known.any():
                self.hits += int(known.sum())
                merged = Run(np.concatenate([run.digests[np.unique(at[known])], digests[known]]), np.concatenate([run.rows[np.unique(at[known])], rows[known]]))
                run.rows[np.searchsorted(run.digests, merged.digests)] = merged.rows
                digests, rows = digests[~known], rows[~known]
        if len(digests):
            self.memory.append((digests, rows))
            self.held += len(digests)
        if self.held >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.runs.append(Run(np.concatenate([d for d, _ in self.memory]), np.concatenate([r for _, r in self.memory])))
            self.memory, self.held = [], 0
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        if len(self.runs) > 1:
            self.runs = [Run(np.concatenate([r.digests for r in self.runs]), np.concatenate([r.rows for r in self.runs]))]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        self.compact()
        return (self.runs[0].digests, self.runs[0].rows) if self.runs else (np.zeros(0, f"S{self.width}"), np.zeros((0, 3), np.int64))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(text: Column, width: int) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, width)


def _entries(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), f"S{width}")
    return digests, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("keep_id", "ties", "group_size")], 1)


def _batch(digests: np.ndarray, rows: np.ndarray, width: int) -> pa.RecordBatch:
    raw = digests.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), *[pa.array(rows[:, j]) for j in range(3)]], schema=_INDEX)


def _merge(width: int):
    """Batches of entries in, the task's compacted entries out; a digest comes out again after every EMIT entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(width)
        for batch in batches:
            if batch.num_rows:
                index.add(*_entries(batch, width))
            if len(index) > EMIT:
                yield _batch(*index.entries(), width)
                index = LsmIndex(width)
        if len(index):
            yield _batch(*index.entries(), width)

    return run


def _merge_sorted(width: int):
    """Batches of entries in, ascending by digest; one entry a digest out, however many there are. Holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, f"S{width}"), np.zeros((0, 3), np.int64)  # the last digest, which the next batch may go on with
        for batch in batches:
            if batch.num_rows:
                digests, rows = folded(*(np.concatenate(x) for x in zip(held, _entries(batch, width), strict=True)))
                held = digests[-1:], rows[-1:]
                yield _batch(digests[:-1], rows[:-1], width)
        if len(held[0]):
            yield _batch(*held, width)

    return run


def build_index(digests: DataFrame, width: int) -> DataFrame:
    """digests: digest, doc_id. One row a digest: keep_id (a null doc_id as the largest long), ties, group_size."""
    rows = digests.select("digest", F.coalesce("doc_id", F.lit(_NULL)).alias("keep_id"), F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("group_size"))
    runs = rows.mapInArrow(_merge(width), INDEX_SCHEMA)
    return runs.repartition(partitions_for(digests.sparkSession), "digest").sortWithinPartitions("digest").mapInArrow(_merge_sorted(width), INDEX_SCHEMA)


def exact_dedup(docs: DataFrame, width: int = 32) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space (space, \\x09-\\x0D) becomes one space; null is empty.
    Of equal texts the smallest doc_id stays; a null doc_id counts as larger than all others. All rows that repeat the kept
    doc_id with the same text are marked kept. width: bytes of the sha256 that the index keys on; texts that share a key without
    being equal are told apart by their bytes.
    """
    base = documents(docs, "doc_id", "text").withColumn("text", normalised(F.col("text")))
    digests = materialise(base.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "digests")
    keyed, total = digests.withColumn("digest", F.substring("sha", 1, width)), digests.count()
    index = materialise(build_index(keyed, width), "index")
    marks = index.select("digest", "keep_id", "group_size")
    hits = index.where("group_size > 1").select("digest", "group_size")
    texts = base.withColumn("digest", _digest(F.col("text"), width))
    texts = texts.join(F.broadcast(hits.select("digest")), "digest", "left_semi") if hits.count() <= FEW else joined(texts, hits, "digest", "group_size", total, "left_semi")
    checked = texts.groupBy("digest", "text").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    clash = materialise(gathered(checked.select("digest")), "clash")
    if clash.isEmpty():
        found = joined(keyed, marks, "digest", "group_size", total).select("doc_id", "sha", "keep_id", "group_size")
    else:  # the same key for different texts: those rows go by the text itself
        clash = clash.join(hits, "digest").select("digest", "group_size")
        plain = joined(keyed, marks.join(clash.select("digest"), "digest", "left_anti"), "digest", "group_size", total)
        whole = joined(base.withColumn("digest", _digest(F.col("text"), width)), clash, "digest", "group_size", total, "left_semi")
        groups = whole.groupBy("digest", "text").agg(F.min(F.coalesce("doc_id", F.lit(_NULL))).alias("keep_id"), F.count("*").alias("group_size"))
        split = whole.join(groups, ["digest", "text"]).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "keep_id", "group_size")
        found = plain.select("doc_id", "sha", "keep_id", "group_size").unionByName(split)
    return found.select(
        "doc_id",
        F.when(F.col("keep_id") != _NULL, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.coalesce("doc_id", F.lit(_NULL)) == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all its columns; of rows that repeat a kept doc_id with the same text, the
    one with the smallest text as it stands stays. Names of extra columns can't clash."""
    columns = docs.columns
    marks = exact_dedup(docs).select(F.coalesce("doc_id", F.lit(_NULL)).alias("id"), F.unhex("text_sha256").alias("sha"), "kept")
    gone = materialise(gathered(marks.where(~F.col("kept")).select("id", "sha").distinct()), "gone")
    again = materialise(gathered(marks.where("kept").groupBy("id", "sha").agg(F.count("*").alias("n")).where("n > 1").select("id", "sha")), "again")
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce("doc_id", F.lit(_NULL)).alias("id"), sha.alias("sha"))
    left = rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, ["id", "sha"], "left_anti")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= FEW else again
        one = left.join(again, ["id", "sha"], "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
        left = left.join(again, ["id", "sha"], "left_anti").select("row").unionByName(one.select("row"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
