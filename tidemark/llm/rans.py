"""Static range asymmetric numeral system over token ids, with numpy vectors of interleaved states.

A chunk holds a frequency table and blocks that share it. Each block interleaves LANES states over its own stream of 32-bit
words, and stores checkpoints (states and stream offset) every so many steps and a checksum of its ids, so that any
checkpoint's stretch of any block can be decoded by itself. Decoding advances all stretches of all blocks together.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

LANES, STEPS, CHECKPOINT = 128, 512, 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIIQII")
_MAGIC = b"TMR1"


class CorruptBlock(ValueError):
    """A block whose ids don't match its checksum."""


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct ids ascending, their frequencies, bits): the frequencies are at least 1 and add up to 2^bits."""
    if len(ids) and int(ids.max()) < 1 << 22:
        every = np.bincount(ids)
        symbols = np.flatnonzero(every).astype(ids.dtype)
        counts = every[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if not len(symbols):
        symbols, counts = np.zeros(1, ids.dtype), np.ones(1, np.int64)
    bits = int(np.clip(int(np.ceil(np.log2(len(symbols)))) + 3, 12, 24))
    total = 1 << bits
    freq = np.maximum(1, (counts * total) // counts.sum())
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # take from the most frequent ones
        for i in order:
            cut = min(over, int(freq[i]) // 2)
            freq[i] -= cut
            over -= cut
            if not over:
                break
    return symbols.astype(np.uint32), freq.astype(np.uint64), bits


def encode(ids: np.ndarray) -> bytes:
    """One chunk. ids: unsigned integers of up to 32 bits; may be empty."""
    ids = np.ascontiguousarray(ids, np.uint32)
    symbols, freq, bits = table(ids)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    lanes = int(min(LANES, max(1, len(ids))))
    blocks = max(1, -(-len(ids) // (LANES * STEPS)))
    steps = max(1, -(-len(ids) // (blocks * lanes)))
    if int(symbols[-1]) < 1 << 22:
        place = np.zeros(int(symbols[-1]) + 1, np.int32)
        place[symbols] = np.arange(len(symbols), dtype=np.int32)
        order = place[ids]
    else:
        order = np.searchsorted(symbols, ids)
    fill = int(np.argmax(freq))
    sym = np.full(blocks * steps * lanes, fill, np.int32)
    sym[: len(ids)] = order
    sym = sym.reshape(blocks, steps, lanes)
    x = np.full((blocks, lanes), _LOW, np.uint64)
    words, took = np.zeros((blocks, steps, lanes), np.uint32), np.zeros((blocks, steps, lanes), bool)
    b, high = np.uint64(bits), np.uint64(32)
    marks = []
    for s in range(steps - 1, -1, -1):
        f, c = freq[sym[:, s]], start[sym[:, s]]
        m = x >= ((_LOW >> b) << high) * f
        words[:, s], took[:, s] = x.astype(np.uint32), m
        x = np.where(m, x >> high, x)
        q = x // f
        x = (q << b) + (x - q * f) + c
        if s % CHECKPOINT == 0:
            marks.append(x.copy())
    states = np.stack(marks[::-1], 1)  # [block, checkpoint, lane]
    per_step = took.sum(2)
    offsets = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(per_step, 1)], 1)
    starts = offsets[:, : steps : CHECKPOINT].astype(np.uint32)
    size = steps * lanes
    sums = np.array([zlib.crc32(ids[i * size : (i + 1) * size].tobytes()) for i in range(blocks)], np.uint32)
    head = zstandard.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 3)
    return b"".join([_HEAD.pack(_MAGIC, lanes, steps, blocks, len(symbols), bits, len(ids), len(head), CHECKPOINT), head, offsets[:, -1].astype("<u4").tobytes(), sums.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), states.astype("<u8").tobytes(), words[took].astype("<u4").tobytes()])


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; raises CorruptBlock where a block doesn't match its checksum."""
    magic, lanes, steps, blocks, n_symbols, bits, n, head, every = _HEAD.unpack_from(chunk)
    if magic != _MAGIC:
        raise CorruptBlock("not a chunk of token ids")
    at = _HEAD.size
    raw = zstandard.decompress(chunk[at : at + head])
    at += head
    symbols = np.cumsum(np.frombuffer(raw, "<u4", n_symbols), dtype=np.uint32)
    freq = np.frombuffer(raw, "<u4", n_symbols, 4 * n_symbols).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    marks = -(-steps // every)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(chunk, kind, count, at)
        at += out.nbytes
        return out

    sizes, sums = take("<u4", blocks).astype(np.int64), take("<u4", blocks)
    starts = take("<u4", blocks * marks).reshape(blocks, marks).astype(np.int64)
    x = take("<u8", blocks * marks * lanes).reshape(blocks * marks, lanes).copy()
    words = np.append(take("<u4", int(sizes.sum())), np.uint32(0)).astype(np.uint64)
    slot = np.repeat(np.arange(n_symbols, dtype=np.int32), freq.astype(np.int64))
    ptr = (starts + (np.cumsum(sizes) - sizes)[:, None]).reshape(-1)
    out = np.zeros((blocks * marks, every, lanes), np.int32)
    b, mask, high = np.uint64(bits), np.uint64((1 << bits) - 1), np.uint64(32)
    last = len(words) - 1
    for s in range(min(every, steps)):
        low = x & mask
        sym = slot[low.astype(np.int64)]
        out[:, s] = sym
        x = freq[sym] * (x >> b) + low - start[sym]
        need = x < _LOW
        rank = np.cumsum(need, 1)
        got = words[np.minimum(ptr[:, None] + rank - 1, last)]
        x = np.where(need, x << high | got, x)
        ptr = ptr + rank[:, -1]
    ids = symbols[out.reshape(blocks, marks * every, lanes)[:, :steps].reshape(-1)][:n]
    size = steps * lanes
    for i in range(blocks):
        if zlib.crc32(ids[i * size : (i + 1) * size].astype("<u4").tobytes()) != sums[i]:
            raise CorruptBlock(f"block {i} doesn't match its checksum")
    return ids
