"""Operator 1: language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It reads whole texts, ASCII letters lowered and each run of white space as one space, in
stretches of SPAN bytes in both directions, the state carried across words and white space, and gives a distribution over the
languages at every byte; a text's probabilities are the mean over all its bytes. At either end a stretch overlaps its
neighbours by MARGIN bytes, whose labels the neighbours give, so that no byte is labelled without its context.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, documents, fold, lower_ascii, slices

SAMPLE = 250  #: documents of each language used for training, at most
DRAWS = 12  #: stretches drawn at random from each of them
LEARNED = 64  #: bytes of a stretch that is learned from
SPAN, MARGIN = 256, 16  #: bytes labelled at once, and bytes read before and after them
STEP = 32  #: widths of shorter texts are multiples of it
ROWS = 512  #: stretches that advance together
HIDDEN = 16
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Gru:
    """Two gated recurrent layers, one each way, and a softmax at every position. p: parameters by name."""

    p: dict[str, np.ndarray]
    langs: list[str]

    @staticmethod
    def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Gru:
        rng = np.random.default_rng(seed)
        p = {}
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, 0.3, (256, 3 * hidden))  # a byte's row serves as its embedding times the input weights
            p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            p[f"c{way}"] = np.zeros(3 * hidden)
        p["o"], p["d"] = rng.normal(0, 0.3, (2 * hidden, len(langs))), np.zeros(len(langs))
        return Gru({k: v.astype(np.float32) for k, v in p.items()}, langs)

    def _run(self, way: str, grid: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States [time, row, hidden]; dead positions carry the state on."""
        x, h, c = self.p[f"x{way}"], self.p[f"h{way}"], self.p[f"c{way}"]
        n, k = len(grid), h.shape[0]
        s, out = np.zeros((n, k), np.float32), np.zeros((grid.shape[1], n, k), np.float32)
        times = range(grid.shape[1]) if way == "f" else range(grid.shape[1] - 1, -1, -1)
        for t in times:
            a = x[grid[:, t]] + c
            u = s @ h[:, : 2 * k]
            zr = _sigmoid(a[:, : 2 * k] + u)
            z, r = zr[:, :k], zr[:, k:]
            rs = r * s
            g = np.tanh(a[:, 2 * k :] + rs @ h[:, 2 * k :])
            m = live[:, t, None]
            new = np.where(m, s + z * (g - s), s)
            if keep is not None:
                keep.append((t, s, z, r, rs, g, m))
            s = out[t] = new
        return out

    def logits(self, grid: np.ndarray, live: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        tapes = {"f": [] if keep is not None else None, "b": [] if keep is not None else None}
        both = np.concatenate([self._run(w, grid, live, tapes[w]) for w in "fb"], 2)
        if keep is not None:
            keep.update(tapes)
        return both @ self.p["o"] + self.p["d"], both

    def gradients(self, grid: np.ndarray, live: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        tape: dict = {}
        q, both = self.logits(grid, live, tape)
        q = np.exp(q - q.max(2, keepdims=True))
        q /= q.sum(2, keepdims=True)
        at = live.T * weight
        total = at.sum()
        rows = np.arange(len(grid))
        loss = float(-(np.log(q[:, rows, label] + 1e-12) * at).sum() / total)
        dq = q * (at / total)[:, :, None]
        dq[:, rows, label] -= at / total
        g = {"o": np.einsum("tnk,tnl->kl", both, dq, optimize=True), "d": dq.sum((0, 1))}
        dh = dq @ self.p["o"].T
        k = self.p["hf"].shape[0]
        for way, cut in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            h = self.p[f"h{way}"]
            gh, gx, gc = np.zeros_like(h), np.zeros_like(self.p[f"x{way}"]), np.zeros(3 * k, np.float32)
            back = np.zeros((len(grid), k), np.float32)
            for t, s, z, r, rs, c, m in reversed(tape[way]):
                d = back + dh[t, :, cut]
                dn = np.where(m, d, 0)
                dz, dc = dn * (c - s) * z * (1 - z), dn * z * (1 - c * c)
                drs = dc @ h[:, 2 * k :].T
                dr = drs * s * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                gh[:, : 2 * k] += s.T @ da[:, : 2 * k]
                gh[:, 2 * k :] += rs.T @ dc
                gc += da.sum(0)
                np.add.at(gx, grid[:, t], da)
                back = np.where(m, dn * (1 - z) + drs * r + da[:, : 2 * k] @ h[:, : 2 * k].T, d)
            g |= {f"h{way}": gh, f"x{way}": gx, f"c{way}": gc}
        return loss, g


def train(stretches: dict[str, list[bytes]], steps: int = 450, batch: int = 256, seed: int = 11) -> Gru | None:
    """Learns from stretches of text of each language. Without any there is no model."""
    langs = sorted(k for k, v in stretches.items() if v)
    if not langs:
        return None
    net, rng = Gru.fresh(langs), np.random.default_rng(seed)
    if len(langs) == 1:
        return net
    pool = [stretches[k] for k in langs]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        label = np.sort(rng.integers(0, len(langs), batch))
        picked = [pool[i][j] for i, j in zip(label.tolist(), rng.integers(0, 1 << 62, batch).tolist(), strict=True) for j in (j % len(pool[i]),)]
        grid, live = _grid(picked)
        _, g = net.gradients(grid, live, label, np.ones(batch, np.float32))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1, step / 50) * (0.1 ** (step / steps))
        for name, x in g.items():
            x = x * min(1, 1 / (norm + 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * x
            v[name] = 0.99 * v[name] + 0.01 * x * x
            net.p[name] = (net.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _grid(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the stretches, padded with 0, and which of them are real."""
    lens = np.fromiter(map(len, stretches), np.int64, len(stretches))
    live = np.arange(lens.max()) < lens[:, None]
    grid = np.zeros(live.shape, np.uint8)
    grid[live] = np.frombuffer(b"".join(stretches), np.uint8)
    return grid, live


def read_as(text: bytes) -> bytes:
    """The text as the network reads it."""
    return b" ".join(lower_ascii(text).split())


def drawn(text: bytes, seed: int, draws: int = DRAWS) -> list[bytes]:
    """Stretches of LEARNED bytes from random places of a text; the whole text if it is no longer."""
    if len(text) <= LEARNED:
        return [text] if text else []
    at = np.random.default_rng(seed).integers(0, len(text) - LEARNED + 1, draws)
    return [text[i : i + LEARNED] for i in sorted(set(at.tolist()))]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Gru | None:
    """Trains on at most `sample` documents of every language, those of the smallest hash among rows with a language whose fold
    isn't held out. Tasks draw DRAWS stretches of LEARNED bytes from each; those alone go to the driver, 200 kB a language."""
    order = F.xxhash64("doc_id")
    known = docs.select("doc_id", "lang").where("lang is not null").where(fold(5) != 0).withColumn("order", order)
    ranked = known.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("nth") <= sample)
    limits = ranked.groupBy("lang").agg(F.max("order").alias("top"))  # one row a language
    rows = documents(docs, "doc_id", "text", "lang").where(fold(5) != 0).join(F.broadcast(limits), "lang").where(order <= F.col("top")).select("lang", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                got = [(lang, x) for lang, i, t in zip(part.column("lang").to_pylist(), part.column("doc_id").to_pylist(), texts, strict=True) for x in drawn(read_as(t), zlib.crc32(str(i).encode()))]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], names=["lang", "stretch"])

    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("stretch"), "stretch"))  # rows may share a doc_id
    got = rows.mapInArrow(run, "lang string, stretch binary").withColumn("nth", turn).where(F.col("nth") <= sample * DRAWS).drop("nth").toArrow()
    stretches: dict[str, list[bytes]] = {}
    for lang, x in sorted(zip(got.column("lang").to_pylist(), got.column("stretch").to_pylist(), strict=True)):
        stretches.setdefault(lang, []).append(x)
    return train(stretches)


class Reader:
    """A network made ready to read: both directions at once, the halved weights of the gates in one matrix each, rows of a
    block along the last axis."""

    def __init__(self, net: Gru) -> None:
        k = net.p["hf"].shape[0]
        half = np.concatenate([np.full(2 * k, 0.5), np.ones(k)]).astype(np.float32)  # sigmoid(x) is tanh(x / 2) / 2 + 1 / 2
        self.k, self.out, self.bias = k, np.ascontiguousarray(net.p["o"].T), net.p["d"][:, None]
        self.x = [np.ascontiguousarray(((net.p[f"x{w}"] + net.p[f"c{w}"]) * half).T) for w in "fb"]
        h = np.stack([(net.p[f"h{w}"] * half).T for w in "fb"])
        self.gates, self.new = np.ascontiguousarray(h[:, : 2 * k]), np.ascontiguousarray(h[:, 2 * k :])

    def probabilities(self, grid: np.ndarray) -> np.ndarray:
        """[time, language, row] for rows of equal length."""
        n, wide = grid.shape
        k, s = self.k, np.zeros((2, self.k, n), np.float32)
        both = np.empty((wide, 2 * k, n), np.float32)
        turned = np.ascontiguousarray(grid.T).astype(np.intp)
        a, u, r, g = (np.empty((2, m, n), np.float32) for m in (3 * k, 2 * k, k, k))
        for t in range(wide):
            np.take(self.x[0], turned[t], 1, a[0], "clip")
            np.take(self.x[1], turned[wide - 1 - t], 1, a[1], "clip")
            np.matmul(self.gates, s, u)
            u += a[:, : 2 * k]
            np.tanh(u, u)
            u += 1
            u *= 0.5
            np.multiply(u[:, k:], s, r)
            np.matmul(self.new, r, g)
            g += a[:, 2 * k :]
            np.tanh(g, g)
            g -= s
            g *= u[:, :k]
            s += g
            both[t, :k], both[wide - 1 - t, k:] = s
        q = np.matmul(self.out, both)
        q += self.bias
        q -= q.max(1, keepdims=True)
        np.exp(q, q)
        q /= q.sum(1, keepdims=True)
        return q

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum over its bytes of each language's probability.

        A text's last stretch is read from further back, so that it is as long as the others. Texts shorter than a stretch are
        filled up with spaces, which get no label, to a multiple of STEP bytes; so few blocks of different width arise.
        """
        out = np.zeros((len(texts), len(self.bias)))
        full = SPAN + 2 * MARGIN
        places: dict[int, list[tuple[int, int, int, int]]] = {}  # by width: text, first byte read, first and end of those labelled
        for i, t in enumerate(texts):
            size = len(t)
            for a in range(0, size, SPAN):
                low = max(0, min(a - MARGIN, size - full))
                wide = full if size >= full else -(-size // STEP) * STEP
                places.setdefault(wide, []).append((i, low, a - low, min(a + SPAN, size) - low))
        for wide, at in places.items():
            steps = np.arange(wide)[:, None]
            for first in range(0, len(at), ROWS):
                part = at[first : first + ROWS]
                grid = np.frombuffer(b"".join([texts[i][low : low + wide].ljust(wide) for i, low, _, _ in part]), np.uint8).reshape(len(part), wide)
                q = self.probabilities(grid)
                edges = np.array([p[2:] for p in part])
                q *= ((steps >= edges[:, 0]) & (steps < edges[:, 1]))[:, None]
                np.add.at(out, [p[0] for p in part], q.sum(0).T)
        return out


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the mean probability of that language over all bytes, a run of
    white space counting as one).

    lang_pred is `und` with score 0 where the text is null or has no letter (Unicode category L), and everywhere if no row has
    a language to learn from. Ties go to the language that sorts first.
    """
    net = fit(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            for part, texts in slices(batch):
                lettered = np.array([net is not None and _LETTER.search(t.decode()) is not None for t in texts], bool)
                pred, score = np.array(["und"] * len(texts), object), np.zeros(len(texts))
                if lettered.any():
                    mine = [read_as(t) for t, has in zip(texts, lettered, strict=True) if has]
                    mean = reader.sums(mine) / np.array([[len(t)] for t in mine])
                    best = mean.argmax(1)
                    pred[lettered] = np.array(net.langs, object)[best]
                    score[lettered] = np.clip(mean[np.arange(len(best)), best], 0, 1)
                yield arrow({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pred.tolist(), "score": score}, _OUT)

    return documents(docs, "doc_id", "text").withColumn("held_out", fold(5) == 0).mapInArrow(run, SCHEMA)
