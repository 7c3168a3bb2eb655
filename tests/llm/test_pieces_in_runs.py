"""Token ids of pieces that are encoded many at a time."""

from __future__ import annotations

import json
import random

import pytest

from tidemark.llm import token_files
from tidemark.llm.queries import BPE_JSON, tokenizer_path

SOME = " \n\t\r 　 \x1c\x85a'sAé1.<|ß日カ£👍"


def check(encoder, texts):
    ids, n = encoder.encode([t.encode() for t in texts])
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
        at += k
    assert at == len(ids)


def made(rng, n, most):
    return ["".join(rng.choice([*SOME, " ", " ", "<|endoftext|>"]) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 40, 1 << 16])
def test_runs_equal_whole_texts(monkeypatch, size):
    monkeypatch.setattr(token_files, "RUN_BYTES", size)
    rng = random.Random(size)
    encoder = token_files.Encoder(tokenizer_path(BPE_JSON))
    for _ in range(4):
        check(encoder, made(rng, 800, 40))


def test_lines_and_symbols_take_few_calls():
    encoder = token_files.Encoder(tokenizer_path(BPE_JSON))
    calls, inner = [], encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return inner.encode_batch_fast(texts, **how)

    encoder.tokenizer = Counted()
    encoder.encode([" ".join(f"word{i} é{i}.\nline{i} <{i}> £{i}" for i in range(i, i + 100)).encode() for i in range(0, 10_000, 100)])
    assert len(calls) < 20


@pytest.mark.parametrize("unk", [None, "<unk>"])
def test_bytes_that_no_token_stands_for(tmp_path, unk):
    spec = json.loads(open(tokenizer_path(BPE_JSON)).read())
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if "z" not in t and "b" not in t}
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if "z" not in "".join(m) and "b" not in "".join(m)]
    if unk:
        spec["model"]["vocab"][unk] = max(spec["model"]["vocab"].values()) + 1
        spec["model"] |= {"unk_token": unk, "fuse_unk": True}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    rng = random.Random(5)
    check(token_files.Encoder(str(tmp_path / "t.json")), ["".join(rng.choice("zzzzbba d. ") for _ in range(rng.randint(0, 30))) for _ in range(400)])


def test_added_tokens_of_several_bytes_a_character(tmp_path):
    spec = json.loads(open(tokenizer_path(BPE_JSON)).read())
    top = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), 0)
    spec["added_tokens"].append({"id": top + 1, "content": "日é", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    (tmp_path / "t.json").write_text(json.dumps(spec))
    rng = random.Random(6)
    check(token_files.Encoder(str(tmp_path / "t.json")), ["".join(rng.choice(["日é", "日", "é", "a", " ", "."]) for _ in range(rng.randint(0, 30))) for _ in range(400)])
