"""What only large inputs reach, with the bounds set low: many buckets, hot keys, large clusters, hubs; and names that clash."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import _components, _tokens
from tidemark.llm import blocks, common, components, exact_dedup, jaccard_join, lm_scores, mixing


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def many_buckets(monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(blocks, "MOST", 3)


@pytest.fixture
def everything_heavy(monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 1)
    monkeypatch.setattr(exact_dedup, "FEW", 0)
    monkeypatch.setattr(mixing, "SOURCES", 0)


def test_jaccard_with_more_buckets_than_partitions(docs, many_buckets):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == _components(texts, 4, 85)


def brute_scores(texts: dict[int, str]) -> dict[int, float]:
    """Interpolated log10 probabilities by dictionaries; the mixture weights come from learn()."""
    kinds = {i: lm_scores.kind_of(i) for i in texts}
    tok = {i: ["<s>", *_tokens(t), "</s>"] for i, t in texts.items()}

    def counts(ids):
        one = Counter(w for i in ids for w in tok[i])
        two = Counter(p for i in ids for p in zip(tok[i], tok[i][1:]))
        return one, two

    train = [i for i in tok if kinds[i] != lm_scores.HELD_OUT]
    one, two = counts(train)
    less_one, less_two = counts([i for i in train if kinds[i] != lm_scores.DELETED])
    v, n = len([w for w in one if w != "<s>"]), sum(c for w, c in one.items() if w != "<s>")

    def bucket(seen):
        return min(int(math.log2(seen + 1)), lm_scores.BUCKETS - 1)

    cell = lambda p: min(max(math.floor(lm_scores.STEP * math.log2(p * (v + 1))) + 64, 0), 400) if p > 0 else -1
    grid = Counter()
    for i in train:
        if kinds[i] == lm_scores.DELETED:
            for a, b in zip(tok[i], tok[i][1:]):
                seen = less_one[a]
                grid[bucket(seen), cell(less_one[b] / n), cell(less_two[a, b] / seen) if seen else -2] += 1
    import numpy as np

    cells = sorted(grid)
    lam = lm_scores.learn(np.array(cells), np.array([float(grid[c]) for c in cells]), 2)
    out = {}
    for i, ws in tok.items():
        s = 0.0
        for a, b in zip(ws, ws[1:]):
            seen = one[a]
            w = lam[bucket(seen)]
            p = w[0] / (v + 1) + w[1] * one[b] / n
            s += math.log10(p + w[2] * two[a, b] / seen if seen else p / (w[0] + w[1]))
        out[i] = s
    return out


@pytest.mark.parametrize("buckets", ["few", "many"])
def test_lm_scores_against_dictionaries(docs, request, buckets):
    if buckets == "many":
        request.getfixturevalue("many_buckets")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = brute_scores(texts)
    for r in lm_scores.lm_scores(docs).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)


def test_mixture_is_a_distribution():
    import numpy as np

    lam = np.array([[0.2, 0.3, 0.5]])
    p, there = np.array([[0.25] * 4, [0.5, 0.5, 0.0, 0.0], [0.0] * 4]), np.array([[True] * 4, [True] * 4, [False] * 4])
    assert lm_scores.mixed(np.repeat(lam, 4, 0), p, there).sum() == pytest.approx(1)


def test_exact_dedup_with_hot_digests(spark, everything_heavy):
    rows = [(i, "hot  text" if i % 3 else f"text {i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for width in (32, 1):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, width).collect()}
        groups = {}
        for i, t in rows:
            groups.setdefault(" ".join(t.split()), []).append(i)
        assert got == {i: (g[0], len(g)) for g in groups.values() for i in g}
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs).collect()) == sorted(g[0] for g in groups.values())


def test_exact_dedup_with_clashing_names_and_repeated_rows(spark):
    ddl = "doc_id long, text string, __id string, __sha string, __key string, row string, id string, sha string, `a.b` string"
    rows = [(i, t, *[f"{n}{k}" for n in "uvwxyz"], "dot") for k, (i, t) in enumerate([(1, "a"), (1, "a"), (2, "a"), (1, "b"), (None, "c "), (None, "c"), (None, "c\t"), (3, "b")])]
    docs = spark.createDataFrame(rows, ddl)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    got = sorted(map(tuple, left.collect()), key=repr)
    assert [(r[0], r[1].strip()) for r in got] == [(1, "a"), (1, "b"), (None, "c"), (None, "c")] and all(r in rows for r in got)
    assert sorted(jaccard_join.without_near_copies(docs).columns) == sorted(docs.columns)


def test_mixing_with_hot_sources(docs, everything_heavy):
    take = lambda d: sorted(map(tuple, mixing.mix(d).select("doc_id", "copy_no", "mix_key").collect()))
    got = take(docs)
    mixing.SOURCES = 2048
    assert got == take(docs)


def test_components_with_hubs(spark, everything_heavy):
    edges = [(0, i) for i in range(1, 300)] + [(i, 1000) for i in range(300, 500)] + [(i, i + 1) for i in range(2000, 2040)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), in_one_task=0).collect())
    f = jaccard_join.Forest()
    for x, y in edges:
        f.union(x, y)
    assert got == {x: f.find(x) for e in edges for x in e}


@pytest.mark.parametrize("speakers", [1, 8])
def test_large_clusters_of_several_components(spark, monkeypatch, speakers):
    """Near copies of texts that share a long rare passage, so that one cluster holds several components and stragglers."""
    monkeypatch.setattr(jaccard_join, "PART_SETS", 4)
    monkeypatch.setattr(jaccard_join, "SPEAKERS", speakers)
    rng = random.Random(8)
    shared = [f"p{i}" for i in range(12)]
    texts = {}
    for i in range(120):
        group = i % 3 if i < 90 else 10 + i
        own = [f"g{group}w{j}" for j in range(24)]
        for _ in range(rng.randrange(2)):
            own[rng.randrange(24)] = f"x{rng.randrange(5)}"
        texts[i] = " ".join([*own, *shared])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 85).collect()}
    assert got == _components(texts, 4, 85)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Cluster(), "x")


def test_fold_of_the_brute_force_agrees(docs):
    got = docs.select("doc_id", (common.fold(5) == 1).alias("h")).collect()
    assert all(r.h == (lm_scores.kind_of(r.doc_id) == lm_scores.HELD_OUT) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert docs.where(F.col("doc_id").isNull()).count() == 0
