"""Operator 2: sentencepiece-style encoding and decoding by a batched Viterbi search in numpy.

The pieces and their order come from a sentencepiece file. Words of one length advance together: at each end position, the
hashes of all substrings of a length probe the sorted keys of the pieces, and a vectorised maximum stores backpointers.
Files of the unigram kind are searched with their log-probabilities. Those of the byte-pair kind hold merge ranks instead;
there a piece of rank r scores -(2^24 + r), so that the segmentation with the fewest pieces wins, and among those the one
with the smallest sum of ranks. Characters outside the pieces fall back to byte pieces.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow, documents, slices

SPACE = "▁"
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
LONG = 48  #: code points of a stretch handled in batches; longer ones take the one-word path
MEMO = 300_000
RANK_STEP = float(1 << 24)  #: score of a piece in byte-pair files, before its rank


class Pieces:
    """Vocabulary of a sentencepiece file, ready for searches."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.text, self.byte_id, byte_of = {}, {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                byte_of[i] = int(piece[3:-1], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[piece] = i
        self.unknown = sp.unk_id()
        ranked = bool(len(scores)) and scores[list(self.text.values())].min() <= -1000 if self.text else False
        order = {i: r for r, i in enumerate(sorted(self.text.values(), key=lambda i: (-scores[i], i)))}
        self.score = {p: -(RANK_STEP + order[i]) if ranked else float(scores[i]) for p, i in self.text.items()}
        worst = min(self.score.values(), default=0.0)
        self.fallback = 4 * worst if ranked else worst - 10.0  # of one character spelt in bytes
        self.longest = max(map(len, self.text), default=1)
        self.byte_of = byte_of
        self.decoded = {i: p.encode() for p, i in self.text.items()} | {i: bytes([b]) for i, b in byte_of.items()}
        by_len: dict[int, list[str]] = {}
        for p in self.text:
            by_len.setdefault(len(p), []).append(p)
        self.tables = {}
        for k, ps in by_len.items():
            grid = np.array([[ord(c) for c in p] for p in ps], np.uint64)
            h = np.zeros(len(ps), np.uint64)
            for j in range(k):
                h = h * np.uint64(_BASE) + grid[:, j] + np.uint64(1)
            at = np.argsort(h)
            assert len(np.unique(h)) == len(h), "two pieces share a hash"
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables[k] = (seen, h[at], np.array([self.text[p] for p in ps])[at], np.array([self.score[p] for p in ps])[at], grid[at])
        #: neighbours in pieces, ascending: a word can be cut between two characters that no piece has side by side
        self.pairs = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.text for a, b in itertools.pairwise(p)], np.int64))
        #: no piece holds a space after another character, so words can be searched one by one
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.text)

    def spell(self, char: str) -> list[int]:
        ids = [self.byte_id.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")]
        return ids if self.unknown not in ids else [self.unknown]

    def one(self, word: str) -> list[int]:
        """The same search for a single word of any length."""
        n = len(word)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for e in range(1, n + 1):
            best[e], back[e] = best[e - 1] + self.fallback, (1, -1)
            for k in range(1, min(self.longest, e) + 1):
                p = word[e - k : e]
                if p in self.score and best[e - k] + self.score[p] > best[e]:
                    best[e], back[e] = best[e - k] + self.score[p], (k, self.text[p])
        out, e = [], n
        while e:
            k, i = back[e]
            out.append([i] if i >= 0 else self.spell(word[e - 1 : e]))
            e -= k
        return list(itertools.chain.from_iterable(reversed(out)))

    def cut(self, word: str) -> list[str]:
        """The word's stretches between places that no piece crosses; their best segmentations in a row are the word's."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = chars[:-1] << 21 | chars[1:]
        at = np.searchsorted(self.pairs, pair)
        joined = at < len(self.pairs)
        joined[joined] = self.pairs[at[joined]] == pair[joined]
        edges = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in itertools.pairwise(edges)]

    def batch(self, words: list[str]) -> list[bytes]:
        """One segmentation a word, as packed ids. Ties go to the shorter last piece, as in one(). Words over LONG are cut where
        no piece crosses, and their stretches searched with the rest; only stretches that are still longer go one by one."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            parts = [self.cut(words[i]) for i in long]
            inside = sorted({p for ps in parts for p in ps if len(p) <= LONG})
            found = dict(zip(inside, self.batch(inside), strict=True))
            out = self._short([w if len(w) <= LONG else "" for w in words])
            for i, ps in zip(long, parts, strict=True):
                out[i] = b"".join([found[p] if p in found else pack(self.one(p)) for p in ps])
            return out
        return self._short(words)

    def _short(self, words: list[str]) -> list[bytes]:
        out = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lens):
            where = np.flatnonzero(lens == n)
            if n == 0:
                continue
            for part in np.array_split(where, max(1, len(where) // 8192)):
                self._equal([words[i] for i in part], int(n), part, out)
        return out

    def _equal(self, words: list[str], n: int, part: np.ndarray, out: list[bytes]) -> None:
        m = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
        prefix = np.zeros((n + 1, m), np.uint64)
        powers = [pow(_BASE, k, 1 << 64) for k in range(n + 1)]
        for j in range(n):
            prefix[j + 1] = prefix[j] * np.uint64(_BASE) + chars[:, j] + np.uint64(1)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        size, ident = np.ones((n + 1, m), np.int64), np.full((n + 1, m), -1, np.int64)
        for e in range(1, n + 1):
            best[e] = best[e - 1] + self.fallback
            for k in range(1, min(self.longest, e) + 1):
                if k not in self.tables:
                    continue
                seen, keys, ids, scores, grid = self.tables[k]
                h = prefix[e] - prefix[e - k] * np.uint64(powers[k])
                hit = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                same = keys[at] == h[hit]
                hit, at = hit[same], at[same]
                same = (grid[at] == chars[hit, e - k : e]).all(1)
                hit, at = hit[same], at[same]
                total = best[e - k, hit] + scores[at]
                won = total > best[e, hit]
                hit = hit[won]
                best[e, hit], size[e, hit], ident[e, hit] = total[won], k, ids[at[won]]
        rows, e = np.arange(m), np.full(m, n)
        steps = np.full((n, m), -2, np.int64)  # from the last piece to the first; -1 is a character spelt in bytes
        spelt, places = np.zeros(m, bool), []
        for t in range(n):
            live = e > 0
            got = np.where(live, ident[e, rows], -2)
            steps[t], spelt = got, spelt | (got == -1)
            places.append(e.copy())
            e = np.where(live, e - size[e, rows], 0)
            if not e.any():
                break
        steps = steps[: t + 1][::-1].T
        counts = (steps != -2).sum(1)
        flat = steps[steps != -2].astype("<i4").tobytes()
        ends = np.cumsum(counts) * 4
        for w, (i, to, c) in enumerate(zip(part.tolist(), ends.tolist(), counts.tolist(), strict=True)):
            if spelt[w]:
                got = [([p] if p >= 0 else self.spell(words[w][at - 1])) for p, at in zip(steps[w][-c:].tolist(), [int(x[w]) for x in places[:c]][::-1], strict=True)]
                out[i] = pack(itertools.chain.from_iterable(got))
            else:
                out[i] = flat[to - 4 * c : to]


def pack(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<i4").tobytes()


def words_of(text: str) -> list[str]:
    """Normalised text cut before each run of spaces; the pieces joined give the normalised text again."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text:  # single spaces within: most texts
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
    parts = text.split(" ")
    out, run = [], 1
    for p in parts:
        if p:
            out.append(SPACE * run + p)
            run = 1
        else:
            run += 1
    if run > 1:
        out.append(SPACE * (run - 1))
    return out


class Codec:
    """Encoder and decoder with a bounded memory of words met before."""

    def __init__(self, model_path: str) -> None:
        self.pieces, self.memo = Pieces(model_path), {}
        if not self.pieces.by_word:
            raise ValueError("the pieces cross word boundaries")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The space mark itself in a text is read as a space, as in the library."""
        split = [words_of(t) for t in texts]
        fresh = set().union(*split).difference(self.memo)
        if len(fresh) + len(self.memo) > MEMO:
            self.memo, fresh = {}, set().union(*split)
        ordered = list(fresh)
        self.memo.update(zip(ordered, self.pieces.batch(ordered), strict=True))
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, ws)), np.int32) for ws in split]
        for w in ordered:
            if len(w) > LONG:
                del self.memo[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.pieces.decoded.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return raw.replace(SPACE, " ").removeprefix(" ")


@functools.lru_cache(1)
def codec_for(model_path: str) -> Codec:
    """A worker process keeps its codec, and the words it has met, from task to task."""
    return Codec(model_path)


SCHEMA = "doc_id long, text string, ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_equal boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_equal", pa.bool_())])


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encodes every whole text, decodes the ids again and compares.

    Returns doc_id, the columns of `keep` (of text and ids), n_pieces, n_byte_pieces (pieces of the byte fallback), ids_crc32 (unsigned crc32 of
    the ids as little-endian 32-bit integers) and decoded_equal: decoding gives the text, the space mark read as a space.
    Null and empty texts have no pieces.
    """
    names = ["doc_id", *[c for c in ("text", "ids") if c in keep], "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_equal"]
    out = pa.schema([_OUT.field(n) for n in names])
    ddl = ", ".join(x.strip() for x in SCHEMA.split(", ") if x.strip().split(" ")[0] in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path)
        is_byte = np.zeros(max(codec.pieces.decoded, default=0) + 1, bool)
        is_byte[list(codec.pieces.byte_of)] = True
        for batch in batches:
            for part, raw in slices(batch):
                texts = [t.decode().replace(SPACE, " ") for t in raw]
                ids = codec.encode(texts)
                rows = {"doc_id": part.column("doc_id"), "n_pieces": [len(x) for x in ids], "n_byte_pieces": [int(is_byte[x].sum()) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}
                rows["decoded_equal"] = [codec.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                if "text" in names:
                    rows["text"] = part.column("text")
                if "ids" in names:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    rows["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                yield arrow(rows, out)

    return documents(docs, "doc_id", "text").mapInArrow(run, ddl)
