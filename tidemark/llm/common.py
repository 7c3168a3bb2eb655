"""Shared helpers: table access, shared scratch tables, slices of record batches, memoised per-word work.

Conventions of every operator in this subpackage, unless its docstring says otherwise:
a null text counts as the empty text; extra columns of the input are ignored, whatever their names; repeated
rows each get their own result; an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  #: text handled at once in a Python worker; a longer single text is a slice of its own
MEMO_WORDS = 250_000  #: distinct words a worker remembers before it starts afresh
LONG_WORD = 256  #: bytes; longer words are not remembered
FEW = 1 << 18  #: rows of a few dozen bytes, counted, that may be broadcast (some 25 MB)
HEAVY = 64  #: rows of a key from which it may count as heavy

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra ones can't clash; null texts become empty."""
    out = docs.select(*columns)
    return out.withColumn("text", F.coalesce("text", F.lit(""))) if "text" in columns else out


def fold(m: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the identifier's decimal text, modulo m; a null identifier counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors see. Only in local mode may that be unset: there a local folder does."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """A small result of many tasks, in a sixteenth of the session's partitions, so that writing it makes fewer files."""
    return df.repartition(max(1, partitions_for(df.sparkSession) // 16))


def joined(left: DataFrame, right: DataFrame, key: str | list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """left.join(right, key, how) for a right side of one row a key, whose column `rows` counts the key's rows in left (total in all).

    Keys with more than an eighth of a partition's even share, of which there are 8 x partitions at most, are broadcast; the
    rest is shuffled. So no key's rows gather in one task.
    """
    heavy = F.col(rows) > max(HEAVY, total // (8 * partitions_for(left.sparkSession)))
    hot, rest = right.where(heavy), right.where(~heavy)
    return left.join(F.broadcast(hot), key, how).unionByName(left.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rest, key, how))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive slices of the batch with at most SLICE_BYTES of UTF-8 text, at least one row each."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        most = (ends[at - 1] if at else 0) + SLICE_BYTES
        to = max(at + 1, int(np.searchsorted(ends, most, "right")))
        yield batch.slice(at, to - at), [x or b"" for x in texts.slice(at, to - at).to_pylist()]
        at = to


class WordTable:
    """Per-word results, computed once for each distinct word a worker meets.

    compute(words) returns one row per word. A word's result must depend on the word alone.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray]) -> None:
        self.compute, self.index, self.rows = compute, {}, None
        self.used = 0

    def look(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number of each token, row number of each token, rows)."""
        fresh = set(itertools.chain.from_iterable(docs)).difference(self.index)
        if len(self.index) + len(fresh) > MEMO_WORDS:
            self.index, self.rows, self.used = {}, None, 0
            fresh = set(itertools.chain.from_iterable(docs))
        if fresh:
            words = sorted(fresh)
            made = np.asarray(self.compute(words))
            need = self.used + len(words)
            if self.rows is None or need > len(self.rows):
                grown = np.zeros((max(need, 2 * (0 if self.rows is None else len(self.rows))), *made.shape[1:]), made.dtype)
                if self.rows is not None:
                    grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : need] = made
            self.index.update(zip(words, range(self.used, need), strict=True))
            self.used = need
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(docs)), np.int64, int(lens.sum()))
        rows = self.rows if self.rows is not None else np.zeros((0, 1))
        for w in [w for w in fresh if len(w) > LONG_WORD]:  # kept for this slice alone
            del self.index[w]
        return np.repeat(np.arange(len(docs)), lens), at, rows


def by_length(words: list[bytes], longest: int = LONG_WORD) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, lengths, bytes padded with 0) for groups of words of like length, none over `longest`."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lens, kind="stable")
    flat = np.frombuffer(b"".join(words), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lens)])
    at = int(np.searchsorted(lens[order], 1))
    while at < len(order) and lens[order[at]] <= longest:
        first = lens[order[at]]
        to = int(np.searchsorted(lens[order], max(first, min(longest, first + first // 4)), "right"))
        to = min(to, at + 16384)
        pick = order[at:to]
        wide = int(lens[pick].max())
        cols = np.arange(wide)
        live = cols < lens[pick][:, None]
        grid = np.zeros((len(pick), wide), np.uint8)
        grid[live] = flat[(starts[pick][:, None] + cols)[live]]
        yield pick, lens[pick], grid
        at = to


def arrow(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if not isinstance(rows[f.name], pa.Array) else rows[f.name].cast(f.type) for f in schema], schema=schema)
