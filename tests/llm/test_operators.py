"""The ten operators against brute force, round trips, held-out accuracy, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, components, exact_dedup, fingerprints, jaccard_join, language_id, lm_scores, mixing, rans, sentencepieces, token_counts, token_files, toxicity
from tidemark.llm.queries import BPE_JSON, PIECES, tokenizer_path

ODD = [(1, "a b a", "x"), (2, "", "y"), (None, None, "z"), (2, "B", "y"), (2, "B", "y"), (7, "q" * 70_000, "y"), (8, " \t\n", None), (9, "é 🎉 ▁x  y\n", "x"), (10, "<|endoftext|> a  b ", "x")]
DDL = "doc_id long, text string, source string, score string, text_sha256 string, block long, __row string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "s", "t", 1, "r") for r in ODD], DDL).withColumn("lang", F.lit("en"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


LABELS = "doc_id long, toxic int, quality int"
RUN = {
    "language_id": lambda d, s: language_id.language_id(d),
    "encode": lambda d, s: sentencepieces.encode(d, tokenizer_path(PIECES)),
    "token_files": lambda d, s: token_files.token_files(d, tokenizer_path(BPE_JSON)),
    "mix": lambda d, s: mixing.mix(d),
    "fingerprints": lambda d, s: fingerprints.fingerprints(d),
    "exact_dedup": lambda d, s: exact_dedup.exact_dedup(d),
    "lm_scores": lambda d, s: lm_scores.lm_scores(d),
    "jaccard": lambda d, s: jaccard_join.jaccard_components(d),
    "token_counts": lambda d, s: token_counts.token_counts(d, tokenizer_path(PIECES)),
    "toxicity": lambda d, s: toxicity.toxicity(d, s.createDataFrame([(1, 1, 0), (7, 0, 1), (9, None, None)], LABELS)),
}


@pytest.mark.parametrize("name", RUN)
def test_odd_rows(spark, odd, name):
    got = RUN[name](odd, spark).collect()
    assert name == "mix" or len(got) == len(ODD)


@pytest.mark.parametrize("name", RUN)
def test_empty_table(spark, odd, name):
    got = RUN[name](odd.limit(0), spark)
    assert got.count() == 0 and got.columns == RUN[name](odd, spark).columns


def test_language_held_out_accuracy(docs):
    r = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1


def test_language_undetermined(spark, odd):
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(odd).where("doc_id in (8, 9)").collect()}
    assert got == {8: "und", 9: "en"}
    rows = [(1, "a b", "en"), (2, "½ ² ①", None), (3, "12 _ !", None), (4, "字", None), (5, "ʰ", None), (6, None, "de")]
    net = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [net[i][0] for i in range(1, 7)] == ["en", "und", "und", "en", "en", "und"] and net[2][1] == 0


def test_every_language_is_learned_and_whole_texts_are_read(spark):
    words = {f"l{i}": [chr(0x430 + i) * 3, chr(0x450 + i) * 2] for i in range(12)}
    rows = [(i * 100 + j, " ".join(random.Random(j).choices(words[f"l{i}"], k=40)), f"l{i}") for i in range(12) for j in range(12)]
    rows += [(-1, " " * 5000 + " ".join(words["l3"] * 300), None)]
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(got.values()) == set(words) and got[-1] == "l3"


def test_reader_labels_every_byte_once(monkeypatch):
    net = language_id.Gru.fresh(["a", "b", "c"], seed=5)
    texts = [b"", b"x", b"some words, and more", bytes(range(256)) * 3, b"ab cd " * 50]

    def whole(t):
        q = np.exp(net.logits(*language_id._grid([t.ljust(-(-len(t) // language_id.STEP) * language_id.STEP)]))[0][:, 0])
        return (q / q.sum(1, keepdims=True))[: len(t)].sum(0)

    monkeypatch.setattr(language_id, "SPAN", 1000)
    assert np.allclose(language_id.Reader(net).sums(texts), [whole(t) if t else np.zeros(3) for t in texts], rtol=1e-4)
    for span in (50, 64, 256):
        monkeypatch.setattr(language_id, "SPAN", span)
        assert np.allclose(language_id.Reader(net).sums(texts).sum(1), [len(t) for t in texts], rtol=1e-4)


def test_gru_gradients():
    net = language_id.Gru.fresh(["a", "b"], hidden=4, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 256, (3, 5)).astype(np.uint8)
    live = np.arange(5) < np.array([[5], [3], [1]])
    label, weight = np.array([0, 1, 1]), np.ones(3)
    _, g = net.gradients(grid, live, label, weight)
    for name in ("hf", "hb", "o", "cf", "xb"):
        at = (int(grid[0, 1]), 2) if name[0] == "x" else (1,) if net.p[name].ndim == 1 else (1, 1)
        kept, loss = net.p[name][at], {}
        for step in (1e-4, -1e-4):
            net.p[name][at] = kept + step
            loss[step] = net.gradients(grid, live, label, weight)[0]
        net.p[name][at] = kept
        assert g[name][at] == pytest.approx((loss[1e-4] - loss[-1e-4]) / 2e-4, rel=0.02, abs=1e-5)


def test_pieces_round_trip_and_best_score(docs, texts):
    assert sentencepieces.encode(docs, tokenizer_path(PIECES)).where("not decoded_equal").count() == 0
    codec = sentencepieces.Codec(tokenizer_path(PIECES))
    p = codec.pieces
    rng = random.Random(5)
    words = [w for t in list(texts.values())[:20] for w in sentencepieces.words_of(t) if len(w) <= 9]
    for w in rng.sample(words, 60) + ["▁🎉é", "▁▁▁a"]:
        best = [0.0] + [-math.inf] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                if w[s:e] in p.score:
                    best[e] = max(best[e], best[s] + p.score[w[s:e]])
            best[e] = max(best[e], best[e - 1] + p.fallback)
        ids = np.frombuffer(p.batch([w])[0], "<i4").tolist()
        spelt = {i: s for s, i in p.text.items()}
        got = sum(p.score[spelt[i]] for i in ids if i in spelt) + p.fallback * len([c for c in w if c not in p.text and c != "▁"])
        assert got == pytest.approx(best[-1]) and ids == p.one(w)


def test_long_words_are_cut_where_no_piece_crosses():
    p = sentencepieces.Codec(tokenizer_path(PIECES)).pieces
    rng = random.Random(7)
    words = ["▁" + "".join(rng.choice(kind) for _ in range(n)) for kind in ("字漢語", "abcdefgh", "a字bZ9/_é🎉", "0123456789abcdef") for n in (47, 48, 60, 300)] + ["▁" + "the" * 40, "▁" * 90]
    assert p.batch(words) == [sentencepieces.pack(p.one(w)) for w in words]
    assert max(map(len, p.cut("▁" + "字" * 300))) <= 2 and "".join(p.cut(words[9])) == words[9]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 70_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 60_000).astype(np.uint32)
    assert (rans.decode(rans.encode(ids)) == ids).all()


def test_rans_detects_damage():
    chunk = bytearray(rans.encode(np.arange(200_000, dtype=np.uint32) % 999))
    chunk[-200_000] ^= 1
    with pytest.raises(rans.CorruptBlock):
        rans.decode(bytes(chunk))


def test_token_files(docs, texts):
    got = {r.doc_id: r for r in token_files.token_files(docs, tokenizer_path(BPE_JSON)).collect()}
    tokenizer = token_files.Encoder(tokenizer_path(BPE_JSON)).tokenizer
    start = 0
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_pieces_equal_whole_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t 　ab'sé1.\x1c <|endoftext|>") for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["x" * 700_000, "a " + "y" * 600_000 + " b"]
    for pieces in (1_000_000, 100):
        e = token_files.Encoder(tokenizer_path(BPE_JSON), pieces)
        ids, n = e.encode([t.encode() for t in texts])
        ends = np.cumsum(n)
        for t, b, k in zip(texts, ends, n, strict=True):
            assert ids[b - k : b].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_mixing_rates(docs):
    got = mixing.mix(docs, total=20_000.0, most=1e9).groupBy("source").count().collect()
    assert len(got) == 20 and all(abs(r["count"] - 1000) < 160 for r in got)
    assert mixing.mix(docs, weights={"src1": 1.0}, total=500.0).select("source").distinct().count() == 1
    assert rows(mixing.mix(docs, copy_column=None, order_column=None)) == rows(mixing.mix(docs.repartition(3), copy_column=None, order_column=None))


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    one = lambda t: fingerprints.digests([t.encode()])
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        k = len(texts[i]) // 2
        new = texts[i][: len(texts[i]) - k] + texts[j][:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprints.hexed(one(texts[i]))[0] and r.edited_fingerprint == fingerprints.hexed(one(new))[0]
        assert r.near_next == fingerprints.likeness(one(texts[i]), one(texts[j]))[0] and 0 <= r.near_edited <= 1


@pytest.mark.parametrize("width", [32, 1])
def test_exact_dedup_with_and_without_colliding_keys(docs, texts, width):
    norm = {i: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for r in exact_dedup.exact_dedup(docs, width).collect():
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())


def test_exact_dedup_keeps_one_row_of_each_text(odd):
    assert sorted((r.text or "") for r in exact_dedup.deduplicated(odd).collect()) == sorted({"a b a", "", "B", "q" * 70_000, " \t\n", ODD[7][1], ODD[8][1]})


def test_lsm_index_merges_runs():
    rng = random.Random(1)
    index, want = exact_dedup.LsmIndex(4, memtable=16, fanout=3), {}
    for _ in range(60):
        batch = [(bytes([rng.randrange(6), 0, rng.randrange(6), 0]), rng.randrange(1000)) for _ in range(9)]
        index.add(np.array([d for d, _ in batch], "S4"), np.array([(i, 1, 1) for _, i in batch]))
        for d, i in batch:
            want.setdefault(d, []).append(i)
    keys, got = index.entries()
    pad = lambda d: d.ljust(4, b"\0")
    assert {pad(d): tuple(r) for d, r in zip(keys.tolist(), got.tolist(), strict=True)} == {d: (min(v), v.count(min(v)), len(v)) for d, v in want.items()}
    assert index.hits > 0


def _tokens(text):
    return text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def test_lm_scores(docs, texts):
    got = {r.doc_id: r for r in lm_scores.lm_scores(docs).collect()}
    tok = {i: [*_tokens(t), "end"] for i, t in texts.items()}
    train = {i for i in tok if zlib.crc32(str(i).encode()) % 5 != 1}
    c = Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def test_interpolation_estimates():
    """Counts that come back through the exchange give the plain relative frequencies."""
    cells = np.array([[3, 100, 64], [3, 90, -1], [0, 80, 120]])
    lam = lm_scores.learn(cells, np.array([5.0, 9.0, 2.0]), 2)
    assert lam.shape == (lm_scores.BUCKETS, 3) and np.allclose(lam.sum(1), 1) and (lam > 0).all()


def _components(texts, k, percent):
    sets, inv = {}, defaultdict(list)
    for i, t in texts.items():
        w = _tokens(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        for s in sets[i]:
            inv[s].append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j, o in Counter(j for s in sets[i] for j in inv[s] if j < i).items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "part"), [(4, 85, 600), (5, 80, 600), (3, 40, 3)])
def test_jaccard_components(docs, texts, monkeypatch, k, percent, part):
    monkeypatch.setattr(jaccard_join, "PART_SETS", part)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent).collect()}
    assert got == _components(texts, k, percent)


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART_SETS", 5)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == _components(texts, 4, 85)


def test_prefix_tree_keeps_every_connection():
    rng = random.Random(4)
    for _ in range(30):
        sets = [np.unique(np.array([rng.randrange(30) for _ in range(rng.randrange(1, 25))], np.uint64)) for _ in range(25)]
        a, b = jaccard_join.Forest(), jaccard_join.Forest()
        for i, j in jaccard_join.tree_links(sets, 60):
            a.union(i, j)
        for i in range(25):
            for j in range(i):
                if 160 * len(np.intersect1d(sets[i], sets[j])) >= 60 * (len(sets[i]) + len(sets[j])):
                    b.union(i, j)
        assert [a.find(i) for i in range(25)] == [b.find(i) for i in range(25)]


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_components(spark, in_one_task):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    f = jaccard_join.Forest()
    for x, y in edges:
        f.union(x, y)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), in_one_task).collect())
    assert got == {x: f.find(x) for e in edges for x in e if e[0] != e[1]}


def test_packed_keys_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (blocks.unpack(blocks.pack(keys)) == keys).all()
    runs = blocks.runs_by_bucket(keys, 7)
    assert [j for _, _, j in runs[:-1]] == [i for _, i, _ in runs[1:]] and (runs[0][1], runs[-1][2]) == (0, len(keys))
    assert all(int(k) * 7 >> 64 == b for b, i, j in runs for k in keys[i:j])
    assert blocks.bucket_of(np.array([2**64 - 1], np.uint64), 2**31).tolist() == [2**31 - 1] and blocks.runs_by_bucket(keys[:0], 7) == []


def test_token_counts(docs, texts):
    begin, inside = map(set, token_counts.pieces_of(tokenizer_path(PIECES)))

    def pieces(w):
        i = k = 0
        while i < len(w):
            for e in range(len(w), i, -1):
                if w[i:e] in (inside if i else begin):
                    break
            else:
                return -1
            i, k = e, k + 1
        return k

    for r in token_counts.token_counts(docs, tokenizer_path(PIECES)).limit(120).collect():
        n = [pieces(w) for w in texts[r.doc_id].encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(n), sum(max(x, 1) for x in n), sum(x < 0 for x in n))


def test_longest_match_needs_the_links():
    m = token_counts.LongestMatch([b"a", b"abcd", b"ab"], [b"c", b"de", b"cdx", b"x"])
    assert m.count([b"abcd", b"abcdx", b"abcde", b"abc", b"abcx", b"", b"b"]).tolist() == [1, 2, -1, 2, 3, 0, -1]


def test_toxicity_held_out(docs, labels):
    r = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert r[0] > 0.93 and r[1] > 0.6


def test_identity_terms_lose_their_weight():
    texts = [b"women are idiots fools"] * 12 + [b"women met at noon"] * 4 + [b"men met at noon today"] * 20 + [b"fools idiots"] * 8
    toxic = np.array([1] * 12 + [0] * 4 + [0] * 20 + [1] * 8)
    neutral = b"women and boys met"
    z = lambda m: m.score({f for w in toxicity.words_of(neutral) for f in toxicity.features_of(w) if f in m.weights})
    with_penalty, without = toxicity.train(texts, toxic, penalty=5.0), toxicity.train(texts, toxic, penalty=0.0)
    assert z(with_penalty) < z(without) - 0.02
    gap = lambda m: abs(m.score(set()) - m.score({f for f in toxicity.features_of(b"women") if f in m.weights}))
    assert gap(without) > 0.05 and gap(with_penalty) < 0.01


def test_nothing_in_the_engine_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(toxicity.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tidemark.llm" in p.read_text()]
