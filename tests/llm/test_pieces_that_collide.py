"""Token ids of pieces whose hashes agree."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import token_files
from tidemark.llm.queries import BPE_JSON, tokenizer_path


def check(encoder, texts):
    ids, n = encoder.encode([t.encode() for t in texts])
    ends = np.cumsum(n)
    for t, b, k in zip(texts, ends, n, strict=True):
        assert ids[b - k : b].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [16, 32, 1024, 4096])
def test_thue_morse_pairs(length):
    """A word and its complement, which every polynomial hash modulo 2^64 confuses."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    encoder = token_files.Encoder(tokenizer_path(BPE_JSON))
    check(encoder, [one, other, f"x {one} {other} {one}", other])
    check(encoder, [other, one])


@pytest.mark.parametrize("pieces", [40, 1000])
def test_all_hashes_alike(monkeypatch, pieces):
    monkeypatch.setattr(token_files, "mix", lambda x: x & np.uint64(6))
    rng = random.Random(9)
    encoder = token_files.Encoder(tokenizer_path(BPE_JSON), pieces)
    for _ in range(20):
        check(encoder, [" ".join("".join(rng.choice("abcé1") for _ in range(rng.choice([1, 2, 3, 8, 9, 17, 40]))) for _ in range(rng.randrange(12))) for _ in range(6)])
