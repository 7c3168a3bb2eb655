"""Blocks of documents and an exchange of packed keys between blocks and buckets.

Counting over a corpus needs each key (a hash of an n-gram) to meet its occurrences everywhere. Instead of a row for each
occurrence, a block of a few MB of text sends its distinct keys, sorted, cut by bucket and delta coded, as one binary value
a bucket; the bucket adds up and answers each block with one number a key, in the block's own order. Blocks are a table in
the shared folder, so a lost executor costs no more than the tasks it ran.

A bucket answers for a bounded part of the keys, so the number of buckets grows with the corpus, but that of shuffle
partitions doesn't: beyond MOST of them a partition takes a range of buckets, sorted, and goes through them one by one. A block
sends nothing to buckets it has no key for, so it never sends more values than it has distinct keys; at worst, with far more
buckets than keys in a block, the exchange is an ordinary shuffle of one row for each distinct key of a block.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, lower_ascii, materialise, partitions_for, slices

BLOCK_BYTES = 4 << 20  #: text of a block; a longer single text is a block of its own
BUCKET_BYTES = 24 << 20  #: text that a bucket answers for, roughly
MOST = 1 << 13  #: shuffle partitions of the exchange
NULL_ID = np.iinfo(np.int64).max  #: stands for a null doc_id, so it counts as the largest
_POS_BITS, _SEQ_BITS = 22, 20
SCHEMA = "block long, kind int, n_docs int, n_bytes long, ids binary, lengths binary, payload binary"
_BLOCK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("n_docs", pa.int32()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])


def write_blocks(docs: DataFrame, kind: Callable[[int], int] | None = None) -> DataFrame:
    """The documents' texts, ASCII letters lowered, as a table of compressed blocks.

    Block numbers are unique, and below 2^41, so that block << 22 | position numbers every row. kind(doc_id) puts documents
    of different kinds into different blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        size: dict[int, int] = {}
        part, seq = TaskContext.get().partitionId(), 0

        def flush(k: int) -> pa.RecordBatch:
            nonlocal seq
            ids, texts = held.pop(k)
            row = [part << _SEQ_BITS | seq, k, len(ids), size.pop(k), np.array(ids, "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.compress(b"".join(texts), 1)]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for piece, texts in slices(batch):
                for i, t in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                    i = NULL_ID if i is None else i
                    k = kind(i) if kind else 0
                    ids, body = held.setdefault(k, ([], []))
                    ids.append(i)
                    body.append(lower_ascii(t))
                    size[k] = size.get(k, 0) + len(t)
                    if size[k] >= BLOCK_BYTES or len(ids) >= 1 << (_POS_BITS - 1):
                        yield flush(k)
        for k in sorted(held):
            yield flush(k)

    return materialise(documents(docs, "doc_id", "text").mapInArrow(run, SCHEMA), "blocks")


def n_buckets(blocks: DataFrame) -> int:
    """Grows with the text, so that a bucket's keys stay bounded; at least the session's shuffle partitions."""
    return max(partitions_for(blocks.sparkSession), -(-int(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))


def texts_of(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """(doc_ids, lower-cased texts) of a block's row."""
    ends = np.cumsum(np.frombuffer(row["lengths"], "<i8")).tolist()
    body = zstandard.decompress(row["payload"]) if row["payload"] else b""
    return np.frombuffer(row["ids"], "<i8"), [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a sequence from the key of all but its last element and the last one's hash."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the texts in a row, words of each text). Words are split text by text, so few are held at once."""
    index: dict[bytes, int] = {}
    at, lens = array("i"), []
    for t in texts:
        words = t.split()
        lens.append(len(words))
        at.extend([index.setdefault(w, len(index)) for w in words])
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    return table[np.frombuffer(at, np.int32)] if at else np.zeros(0, np.uint64), np.array(lens, np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """floor(key * n / 2^64): which of n equal ranges each 64-bit key falls into."""
    high, low, m = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), np.uint64(n)
    return ((high * m + (low * m >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def runs_by_bucket(sorted_keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for each bucket that has keys."""
    at = bucket_of(sorted_keys, n)
    edges = np.concatenate([np.flatnonzero(np.diff(at, prepend=-1)), [len(at)]])
    return list(zip(at[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def by_bucket(rows: DataFrame, n: int, answer: Callable[[int, list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """answer(bucket, all its rows) for each bucket of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = -1, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket and held:
                    yield from answer(bucket, held)
                    held = []
                bucket = r["bucket"]
                held.append(r)
        if held:
            yield from answer(bucket, held)

    if n <= MOST:
        return rows.repartitionById(n, "bucket").mapInArrow(run, schema)
    dealt = rows.repartitionById(MOST, F.floor(F.col("bucket").cast("long") * MOST / n).cast("int"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, schema)


def pack(sorted_keys: np.ndarray) -> bytes:
    step = np.diff(sorted_keys.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_counts(*columns: np.ndarray) -> bytes:
    raw = np.concatenate([np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).reshape(-1) for c in columns])
    return zstandard.compress(raw.tobytes(), 1)


def unpack_counts(data: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(n_columns, 4, -1)
    return [np.ascontiguousarray(c.T).reshape(-1).view("<u4").astype(np.int64) for c in raw]
