"""Operator 3: token ids in files, entropy coded by a range asymmetric numeral system.

Every whole text is encoded with a tokenizer file, an end id follows, and the ids are written in ascending doc_id order. A
file row is a chunk (see rans.py) with the doc_ids and lengths it holds; rows are Parquet, so that Spark's committer makes the
write atomic and any store that Spark reaches will do. Shards are ranges of doc_id, so they can be read in parallel.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import rans
from tidemark.llm.blocks import mix
from tidemark.llm.common import arrow, documents, partitions_for, shared_dir, slices
from tidemark.llm.ordered import packed, range_ends, unpacked

CHUNK_TOKENS = 1 << 20  #: a chunk ends with the document that reaches this many ids
RUN_BYTES = 1 << 16  #: pieces encoded in one go, about
PIECES = 700_000  #: pieces a worker remembers, about 60 MB; when full, it keeps those met again
#: bytes that may follow a space at which a text is cut: not white space, nor a lead byte of characters among which some is
_CUT = np.array([not (0x09 <= b <= 0x0D or 0x1C <= b <= 0x20 or b in (0xC2, 0xE1, 0xE2, 0xE3)) for b in range(256)])
FILE_SCHEMA = "shard int, chunk int, before long, n_docs int, n_tokens long, doc_ids binary, lengths binary, payload binary"
_FILE = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_NULL_ID = -(1 << 63)


class Encoder:
    """A tokenizers file. With byte-level splitting, no token crosses a space that a non-space follows, so texts are cut
    there, and pieces met before are looked up by their bytes; other kinds of tokenizer get whole texts."""

    def __init__(self, path: str, pieces: int = PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
        shown = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(shown.values()) + 1, np.int64)  # bytes of each token's text
        self.width[list(shown.values())] = [len(t) for t in shown]
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(t.content.encode())
        self.no_unknown = (spec.get("model") or {}).get("unk_token") is None  # then a byte without a token leaves no trace
        self.memo = PieceMemo(self._pieces, pieces)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each). Pieces that start as a cut does may follow any others: they are
        encoded many at a time, and the ids dealt back by the bytes that each token stands for. The others, first in their texts, go one by one."""
        flat = np.frombuffer(b"".join(pieces) + b" ", np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(size) - size
        follows = (size > 1) & (flat[starts] == 32) & _CUT[flat[starts + 1]]
        counts, parts = np.zeros(len(pieces), np.int64), []
        some = np.flatnonzero(follows)
        alone = [np.flatnonzero(~follows)]
        runs = np.cumsum(size[some]) // RUN_BYTES
        edges = np.flatnonzero(np.diff(runs, prepend=-1))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(some)], strict=False):
            own = some[i:j].copy()
            ids = self._ids(b"".join([pieces[k] for k in own.tolist()]).decode())
            ends = np.cumsum(self.width[ids])
            if self.no_unknown and len(ids) and ends[-1] == size[own].sum():
                counts[own] = np.diff(np.searchsorted(ends, np.cumsum(size[own]), "right"), prepend=0)
                parts.append(ids)
            else:  # some bytes have no token of their own
                some[i:j] = -1
                alone.append(own)
        lone = np.concatenate(alone)
        for i in range(0, len(lone), 1024):
            got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in lone[i : i + 1024].tolist()], add_special_tokens=False)]
            counts[lone[i : i + 1024]] = [len(x) for x in got]
            parts += got
        ids, order = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([some[some >= 0], lone])
        n = counts[order]
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(n) - n
        return ids[np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))], counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if not self.by_piece:
            got = [self._ids(t.decode()) for t in texts]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = np.concatenate([[0], ends[:-1]]) if len(texts) else ends
        cut = np.zeros(len(flat) + 1, bool)
        cut[:-2] = (flat[:-1] == 32) & _CUT[flat[1:]] if len(flat) > 1 else False
        cut[ends - 1] = False  # what follows belongs to the next text
        cut[starts[starts < ends]] = True
        first = np.flatnonzero(cut)
        ids, counts = self.memo.look(flat, first, np.append(first[1:], len(flat)) if len(first) else first)
        total = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(first, np.concatenate([starts, ends[-1:]]))
        return ids, np.diff(total[at])


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPAN = 32  #: bytes of a piece that is remembered, at most; longer ones are encoded anew


class Keys:
    """Pieces flat[a:b] as numbers: size, the bytes in words of eight, and a hash of both, which is 0 for those over SPAN."""

    def __init__(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        padded = np.concatenate([flat, np.zeros(SPAN + 8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each position on
        self.size = (b - a).astype(np.int32)
        first = eight[a] & _KEEP[np.minimum(self.size, 8)]
        self.words = [first, *(np.zeros(len(a), np.uint64) for _ in range(SPAN // 8 - 1))]
        self.hash = mix(first * _STEP + self.size.astype(np.uint64))
        for k in range(1, SPAN // 8):
            some = np.flatnonzero(self.size > 8 * k)
            if len(some):
                self.words[k][some] = w = eight[a[some] + 8 * k] & _KEEP[np.minimum(self.size[some] - 8 * k, 8)]
                self.hash[some] = mix(self.hash[some] * _STEP + w)
        self.hash |= np.uint64(1)
        self.hash[self.size > SPAN] = 0


class PieceMemo:
    """Token ids by piece, in flat arrays: an open-addressing table of hashes, the pieces' bytes, and a pool of ids.

    A piece that is found by its hash is compared byte by byte; one that shares the hash of another is encoded anew each time.
    A full memory keeps the pieces met again.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int) -> None:
        self.compute, self.most = compute, most
        self.bits = max(4, (2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.hash, self.again, self.size = np.zeros(1024, np.uint64), np.zeros(1024, bool), np.zeros(1024, np.int32)
        self.words = [np.zeros(1024, np.uint64) for _ in range(SPAN // 8)]
        self.start, self.count, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.held = self.used = 0

    def shrink(self) -> None:
        """Keeps what was met again since it came in or since the last time, if that is little enough."""
        kept = np.flatnonzero(self.again[: self.held])
        h, size, words, n, start, pool = self.hash[kept], self.size[kept], [w[kept] for w in self.words], self.count[kept].astype(np.int64), self.start[kept], self.pool
        self.clear()
        if 2 * len(kept) <= self.most:
            self.add(h, size, words, pool[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n)

    def others(self, at: np.ndarray, keys: Keys) -> np.ndarray:
        """The pieces (positions in keys) that a slot was found for which holds another piece."""
        hit = np.flatnonzero(at >= 0) if len(at) and at.min() < 0 else np.arange(len(at))
        slot = at[hit]
        differ = (self.size[slot] != keys.size[hit]) | (self.words[0][slot] != keys.words[0][hit])
        long = np.flatnonzero(keys.size[hit] > 8)
        for mine, theirs in zip(self.words[1:], keys.words[1:], strict=True):
            differ[long] |= mine[slot[long]] != theirs[hit[long]]
        return hit[differ]

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        hit = (got == h) & (h != 0)
        out[hit] = self.slot[at[hit]]
        todo = np.flatnonzero(~hit & (got != 0) & (h != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            hit = got == h[todo]
            out[todo[hit]] = self.slot[at[todo[hit]]]
            todo = todo[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray, size: np.ndarray, words: list[np.ndarray], ids: np.ndarray, counts: np.ndarray) -> None:
        """h: distinct, none held yet."""
        n = len(h)
        for k, old in enumerate(self.words):
            if self.held + n > len(old):
                self.words[k] = np.concatenate([old[: self.held], np.zeros(max(n, self.held // 2), np.uint64)])
            self.words[k][self.held : self.held + n] = words[k]
        for name, need in (("hash", self.held + n), ("again", self.held + n), ("size", self.held + n), ("start", self.held + n), ("count", self.held + n), ("pool", self.used + len(ids))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, len(old) + len(old) // 2), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.start[self.held : self.held + n] = self.used + np.cumsum(counts) - counts
        self.count[self.held : self.held + n] = counts
        self.hash[self.held : self.held + n], self.size[self.held : self.held + n] = h, size
        self.pool[self.used : self.used + len(ids)] = ids
        at, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(n)
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.slot[at[won]] = h[won], self.held + won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.held, self.used = self.held + n, self.used + len(ids)

    def fresh(self, met: Keys, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes of the pieces at gaps, where each first is, and the way back. Of pieces that share a hash the first keeps it."""
        keys, one, back = np.unique(met.hash[gaps], return_index=True, return_inverse=True)
        twin = gaps[one][back]
        differ = (met.hash[gaps] != 0) & (met.size[twin] != met.size[gaps])
        for w in met.words:
            differ |= (met.hash[gaps] != 0) & (w[twin] != w[gaps])
        if differ.any():
            met.hash[gaps[differ]] = 0
            return np.unique(met.hash[gaps], return_index=True, return_inverse=True)
        return keys, one, back

    def look(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces flat[a:b] in a row, number of ids of each)."""
        met = Keys(flat, a, b)
        h = met.hash
        at = self.find(h)
        if len(bad := self.others(at, met)):
            h[bad], at[bad] = 0, -1
        gaps = np.flatnonzero(at < 0)
        self.again[at[at >= 0] if len(gaps) else at] = True
        if len(gaps):
            keys, one, back = self.fresh(met, gaps)
            if self.held + len(keys) > self.most:
                self.shrink()
                at = self.find(h)
                gaps = np.flatnonzero(at < 0)
                keys, one, back = self.fresh(met, gaps)
            raw = flat.tobytes()
            pick = gaps[one]
            if len(keys) and keys[0] == 0:  # pieces too long to be remembered are encoded one by one
                pick = np.concatenate([pick[1:], gaps[h[gaps] == 0]])
                keys = np.concatenate([keys[1:], np.zeros(len(pick) - len(keys) + 1, np.uint64)])
            ids, counts = self.compute([raw[i:j] for i, j in zip(a[pick].tolist(), b[pick].tolist(), strict=True)])
            real = int((keys != 0).sum())
            if self.held + real > self.most:  # one call with more pieces than the table takes: make room
                self.clear()
                while real > self.most:
                    self.bits, self.most = self.bits + 1, 2 * self.most
                self.clear()
                return self.look(flat, a, b)
            base, cut = self.held, int(counts[:real].sum())
            own = pick[:real]
            self.add(keys[:real], met.size[own], [w[own] for w in met.words], ids[:cut], counts[:real])
            long = h[gaps] == 0
            order = np.full(len(gaps), 0, np.int64)
            order[~long] = base + np.searchsorted(keys[:real], h[gaps][~long])
            at[gaps] = order
            if long.any():
                return self._with_long(at, gaps[long], ids[cut:], counts[real:])
        n = self.count[at].astype(np.int64)
        return self.pool[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _with_long(self, at: np.ndarray, where: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[at].astype(np.int64)
        n[where] = counts
        ends, own, out = np.cumsum(n), np.cumsum(counts), []
        edge = 0
        for i, j, k in zip(where.tolist(), own.tolist(), counts.tolist(), strict=True):
            m = n[edge:i]
            out += [self.pool[np.repeat(self.start[at[edge:i]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))], ids[j - k : j]]
            edge = i + 1
        m = n[edge:]
        out.append(self.pool[np.repeat(self.start[at[edge:]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))])
        return np.concatenate(out), n if len(ends) else n


@functools.lru_cache(1)
def encoder_for(path: str) -> Encoder:
    """A worker process keeps its encoder, and the pieces it has met, from task to task."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2) -> None:
    """Encodes and writes. Rows of one doc_id go in the order of their ids' bytes; null doc_ids come first, as the smallest."""
    ends = range_ends(docs.select("doc_id"), partitions_for(docs.sparkSession))
    n = max(1, len(ends))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        kind = "<u2" if len(encoder.width) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end, shrink = np.array([end_id], kind).tobytes(), zstandard.ZstdCompressor(1).compress
        for batch in batches:
            for part, texts in slices(batch):
                ids = [_NULL_ID if i is None else i for i in part.column("doc_id").to_pylist()]
                tokens, counts = encoder.encode(texts)
                tokens, edges = tokens.astype(kind), np.cumsum(counts).tolist()
                coded = [kind.encode() + shrink(tokens[i:j].tobytes() + end) for i, j in zip([0, *edges[:-1]], edges, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.searchsorted(ends, ids), n - 1).astype(np.int32)), pa.array(ids, pa.int64()), pa.array(coded, pa.binary())], names=["pid", "doc_id", "payload"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []
        size = chunk = before = 0
        shard, grow = -1, zstandard.ZstdDecompressor().decompress

        def flush() -> pa.RecordBatch:
            body = rans.encode(np.concatenate(held))
            return arrow({"shard": [shard], "chunk": [chunk], "before": [before], "n_docs": [len(ids)], "n_tokens": [size], "doc_ids": [packed(np.array(ids, "<i8").tobytes())], "lengths": [packed(np.array([len(x) for x in held], "<u4").tobytes())], "payload": [body]}, _FILE)

        for batch in batches:
            for pid, i, body in zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "payload")), strict=True):
                shard = pid
                held.append(np.frombuffer(grow(body[3:]), body[:3].decode()))
                ids.append(i)
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield flush()
                    before, chunk = before + size, chunk + 1
                    ids, held, size = [], [], 0
        if ids:
            yield flush()

    rows = documents(docs, "doc_id", "text").mapInArrow(tokenise, "pid int, doc_id long, payload binary")
    rows.repartitionById(n, "pid").sortWithinPartitions("doc_id", "payload").mapInArrow(pack, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files at path: doc_id, start (ids before it in the whole collection), n_tokens, ids_crc32, and with
    with_ids the ids themselves. Only the shards' totals (one number a shard) come to the driver."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = {r.shard: r.n for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    first, total = {}, 0
    for shard in sorted(totals):
        first[shard], total = total, total + totals[shard]
    out = pa.schema([*_OUT, *([pa.field("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tokens = rans.decode(row["payload"])
                ids, lens = np.frombuffer(unpacked(row["doc_ids"]), "<i8"), np.frombuffer(unpacked(row["lengths"]), "<u4").astype(np.int64)
                ends = np.cumsum(lens)
                cols = {"doc_id": [None if i == _NULL_ID else i for i in ids.tolist()], "start": ends - lens + row["before"] + first[row["shard"]], "n_tokens": lens, "ids_crc32": [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]}
                if with_ids:
                    cols["ids"] = [tokens[a:b].tolist() for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                yield arrow(cols, out)

    return files.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files, into the shared folder unless a path is given, and reads them back. Null and empty texts have the end id alone."""
    path = path or shared_dir(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, path, end_id)
    return read(docs.sparkSession, path)
