"""Operator 5: locality-sensitive fingerprints by a quartile bucket digest.

All byte triplets of a text are hashed into 256 buckets; a bucket's count is written as its quartile among the buckets
(two bits), after a byte for the logarithm of the length. Two digests compare by a bounded score: the distance adds the
quartile differences of all buckets (a difference of three counts double) and the difference of the lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import SLICE_BYTES, arrow, documents, partitions_for, slices
from tidemark.llm.ordered import packed, range_ends, unpacked

BUCKETS = 256
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DEALT = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64()), ("ahead", pa.bool_()), ("tie", pa.binary()), ("payload", pa.binary())])
_FAR = 1.625 * BUCKETS  #: distance expected of unrelated digests, from which on the score is 0


def digests(texts: list[bytes]) -> np.ndarray:
    """One row a text: the length byte, then the quartile (0 to 3) of each bucket."""
    out = np.zeros((len(texts), 1 + BUCKETS), np.uint8)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_BYTES):
            size += len(texts[to])
            to += 1
        lens = np.fromiter(map(len, texts[at:to]), np.int64, to - at)
        flat = np.frombuffer(b"".join(texts[at:to]), np.uint8).astype(np.uint32)
        counts = np.zeros((to - at, BUCKETS), np.int64)
        if len(flat) >= 3:
            h = ((flat[:-2] << np.uint32(16) | flat[1:-1] << np.uint32(8) | flat[2:]) * np.uint32(2654435761)) >> np.uint32(24)
            n = np.maximum(lens - 2, 0)  # triplets that don't reach into the next text
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            doc = np.repeat(np.arange(to - at), n)
            first = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            counts = np.bincount(doc * BUCKETS + h[first + np.arange(len(doc))], minlength=(to - at) * BUCKETS).reshape(-1, BUCKETS)
        ranked = np.sort(counts, 1)
        for q in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1):
            out[at:to, 1:] += counts > ranked[:, q, None]
        out[at:to, 0] = np.minimum(255, np.round(12 * np.log2(1 + lens))).astype(np.uint8)
        at = to
    return out


def hexed(d: np.ndarray) -> list[str]:
    """Lowercase hex: the length byte and four buckets to a byte."""
    q = d[:, 1:].reshape(len(d), -1, 4)
    two = (q[:, :, 0] << 6 | q[:, :, 1] << 4 | q[:, :, 2] << 2 | q[:, :, 3]).astype(np.uint8)
    return [row.tobytes().hex() for row in np.concatenate([d[:, :1], two], 1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1, row by row; 1 for equal digests."""
    gap = np.abs(a[:, 1:].astype(np.int16) - b[:, 1:])
    far = (gap + 3 * (gap == 3)).sum(1) + np.abs(a[:, 0].astype(np.int16) - b[:, 0])
    return np.maximum(0.0, 1 - far / _FAR)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text, or by all of it."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digest of every whole text and of its edited text, and how near they are.

    The next document is the one with the next smaller doc_id; after the last, the first. Rows of one doc_id go by the sha256
    of their text, null doc_ids come last. A single row is its own next one. Null texts are empty; texts of under three bytes
    have only their length in the digest.

    Rows are dealt by ranges of doc_id whose ends are real identifiers, so the row that starts a range is also sent, as a
    look-ahead, to the range before it; each range is then read in order, one slice at a time.
    """
    rows = documents(docs, "doc_id", "text")
    ends = range_ends(docs.select("doc_id"), partitions_for(docs.sparkSession))
    n = max(1, len(ends))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                ids = part.column("doc_id").to_pylist()
                out: dict[str, list] = {f.name: [] for f in _DEALT}
                for i, t in zip(ids, texts, strict=True):
                    at = int(np.searchsorted(ends, i)) if i is not None else -1
                    p = n - 1 - at if i is not None else n - 1
                    first = bool(len(ends)) and i is not None and ends[at] == i or not len(ends)
                    body, tie = packed(t), hashlib.sha256(t).digest()
                    for pid, ahead in [(p, False), ((p - 1) % n, True)][: 1 + first]:
                        for k, v in zip(out, (pid, i, ahead, tie, body), strict=True):
                            out[k].append(v)
                yield arrow(out, _DEALT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size, closed = 0, False

        def flush(last: bool) -> pa.RecordBatch:
            texts = [t.decode() for _, t in held]
            k = len(held) - 1
            new = [edited(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
            d, e = digests([t for _, t in held]), digests(new)
            out = arrow(
                {"doc_id": [i for i, _ in held[:k]], "n_chars": [len(t) for t in texts[:k]], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in new], "fingerprint": hexed(d[:k]),
                 "edited_fingerprint": hexed(e), "near_edited": likeness(d[:k], e), "near_next": likeness(d[:k], d[1:])}, _OUT)
            del held[: k if not last else len(held)]
            return out

        for batch in batches:
            for i, ahead, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ahead", "payload")), strict=True):
                if closed:
                    continue  # further look-ahead rows: the first in order is the next document
                closed = ahead
                held.append((i, unpacked(body)))
                size += len(held[-1][1])
                if len(held) > 1 and size >= SLICE_BYTES and not closed:
                    yield flush(False)
                    size = 0
        if len(held) > 1:
            yield flush(True)

    dealt = rows.mapInArrow(deal, "pid int, doc_id long, ahead boolean, tie binary, payload binary").repartitionById(n, "pid")
    ordered = dealt.sortWithinPartitions("ahead", dealt.doc_id.desc_nulls_last(), "tie")
    return ordered.select("doc_id", "ahead", "payload").mapInArrow(scan, SCHEMA)
