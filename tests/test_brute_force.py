"""Operators that SQL doesn't express, against plain Python; and rules with literal cases."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import claims, facts, ingest, matching, planner, retrieval
from tidemark.plans.registry import QUERIES


def test_settled_values_against_a_fold(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(40)}", rng.randrange(4), i) for i in range(900)] + [("alone", 1, 1000), ("alone", 1, 1001), ("alone", 1, 1002), ("late", 1, 1), ("late", 1, 2), ("late", 1, 3), ("late", 2, 4)]
    held: dict[str, dict[int, list]] = defaultdict(dict)
    for kind, value, _ in sorted(rows, key=lambda r: r[2]):
        mine = held[kind]
        if value in mine:
            mine[value][0] += 1
            if mine[value][0] == 3 and mine[value][1] == "conflicting":
                for v in mine:
                    mine[v][1] = "active" if v == value else "superseded"
        else:
            contested = any(s != "superseded" for _, s in mine.values())
            if contested:
                for v in mine.values():
                    v[1] = "conflicting" if v[1] == "active" else v[1]
            mine[value] = [1, "conflicting" if contested else "active"]
    got = {(r.kind, r.value): (r.mentions, r.state) for r in facts.settled(spark.createDataFrame(rows, "kind string, value int, seq long")).collect()}
    assert got == {(k, v): tuple(x) for k, mine in held.items() for v, x in mine.items()}


def greedy(rows, top, most):
    chosen = []
    for score, doc, exempt, terms in sorted(rows, key=lambda r: (-r[0], r[1])):
        alike = any(len(terms & c[1]) > most * len(terms | c[1]) for c in chosen if terms | c[1])
        if len(chosen) < top and (exempt or not terms or not alike):
            chosen.append((doc, terms))
    return [c[0] for c in chosen]


@pytest.mark.parametrize("exempt", [False, True])
def test_diverse_selection(spark, exempt):
    rng = random.Random(5)
    rows = [(q, d, float(rng.randrange(6)), [f"t{rng.randrange(6)}" for _ in range(rng.randrange(5))], rng.random() < 0.2) for q in range(6) for d in range(25)]
    rows = [(q, d, s, sorted(set(t)), e) for q, d, s, t, e in rows]
    df = spark.createDataFrame(rows, "item_id long, doc_id long, score double, terms array<string>, exempt boolean")
    got = defaultdict(list)
    for r in retrieval.diverse(df if exempt else df.drop("exempt"), "item_id", 5, 0.5).orderBy("item_id", "rank").collect():
        got[r.item_id].append(r.doc_id)
    assert got == {q: greedy([(s, d, e and exempt, set(t)) for k, d, s, t, e in rows if k == q], 5, 0.5) for q in range(6)}


def test_greedy_clusters(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "vec_id", "embedding").collect()
    want = set()
    by = defaultdict(list)
    for r in rows:
        v = np.asarray(r.embedding, float)
        by[r.label].append((r.vec_id, v / np.linalg.norm(v)))
    for label, items in by.items():
        items.sort(key=lambda x: x[0])
        free = {i for i, _ in items}
        for seed, v in items:
            if seed in free:
                near = [seed, *[i for i, w in items if i in free and i != seed and v @ w >= 0.2]][:8]
                if len(near) >= 3:
                    free -= set(near)
                    want |= {(label, seed, i) for i in near}
    assert {tuple(r) for r in QUERIES["greedy_clusters"](spark, sf).collect()} == want and want


def test_clusters_have_a_budget_and_leave_out_what_is_used(spark):
    rows = [(0, i, [1.0, 0.0]) for i in range(30)]
    v = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    got = retrieval.greedy_clusters(v, "label", 0.9, limit=10, used=spark.range(5).withColumnRenamed("id", "vec_id")).collect()
    assert sorted(r.vec_id for r in got) == list(range(5, 13)) and {r.seed for r in got} == {5}


def test_hash_embeddings(spark):
    texts = ["one", "two", "one", None]
    got = retrieval.embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string").na.fill(""), retrieval.hash_embedding).collect()
    for r in got:
        raw, seed = b"", (r.text or "").encode()
        while len(raw) < 64:
            seed = hashlib.sha256(seed).digest()
            raw += seed
        v = np.frombuffer(raw[:64], np.uint8) / 127.5 - 1
        assert np.allclose(r.embedding, v / np.linalg.norm(v), atol=1e-6)
    assert len(got) == 4


def test_a_night_of_merges_and_conflicts(spark):
    rows = [
        # by, id, type, scope, text, embedding, durability, importance, score
        ("a", 1, "semantic", "project", "the sky is low", [1.0, 0.0], 2.0, 5.0, 9.0), ("a", 2, "semantic", "project", "the sky is low today", [0.99, 0.05], 3.0, 5.0, 8.0), ("a", 3, "semantic", "project", "sky low", [1.0, 0.01], 3.0, 5.0, 7.0),
        ("a", 4, "anchor", "project", "x", [1.0, 0.0], 1.0, 5.0, 6.0), ("a", 5, "anchor", "project", "x", [1.0, 0.0], 1.0, 5.0, 5.0), ("a", 6, "procedural", "project", "never keep the old branch around", [0.0, 1.0], 2.0, 5.0, 4.0),
        ("a", 7, "procedural", "project", "always keep the old branch around", [0.0, 1.0], 2.0, 6.0, 3.0), ("a", 8, "semantic", "project", "far", [-1.0, 0.0], 4.0, 5.0, 2.0), ("b", 9, "semantic", "project", "the sky is low", [1.0, 0.0], 1.0, 5.0, 1.0),
        ("a", 10, "causal", "project", "p", [0.5, 0.5], 1.5, 1.0, 1.5), ("a", 11, "causal", "project", "p", [0.5, 0.5], 1.5, 1.0, 1.4),
    ]
    items = spark.createDataFrame(rows, "ws string, id long, memory_type string, scope string, text string, embedding array<double>, durability double, importance double, score double")
    done = spark.createDataFrame([("10::11",)], "signature string")
    got = {r.id: (r.fate, r.durability, r.importance) for r in ingest.reconsolidated(items, "ws", done).collect()}
    assert got == {
        1: ("merged", 2.0, 5.0), 2: ("strengthened", 3.1, 5.0), 3: ("merged", 3.0, 5.0), 4: ("strengthened", 1.1, 5.0), 5: ("strengthened", 1.1, 5.0), 6: ("weakened", 1.3, 4.0), 7: ("strengthened", 2.1, 6.0), 8: ("unchanged", 4.0, 5.0), 9: ("strengthened", 1.1, 5.0),
        10: ("strengthened", 1.6, 1.0), 11: ("strengthened", 1.6, 1.0),
    }


def test_only_the_most_active_are_replayed(spark):
    rows = [("a", i, "semantic", "project", "t", [1.0, 0.0], 1.0, 5.0, float(i)) for i in range(60)]
    items = spark.createDataFrame(rows, "ws string, id long, memory_type string, scope string, text string, embedding array<double>, durability double, importance double, score double")
    got = ingest.reconsolidated(items, "ws").collect()
    assert {r.id for r in got} == set(range(36, 60)) and sum(r.fate == "merged" for r in got) == 23


DDL = "event_id long, subject long, predicate string, observed_at timestamp_ntz, bucket int, kind string"


def relations(spark, predicate, *rows):
    data = [(i, 1, predicate, datetime(2026, 1, 1 + day), b, k) for i, (b, k, day) in enumerate(rows)]
    return [(r.relation, r.held) for r in claims.held_relations(spark.createDataFrame(data, DDL)).orderBy("event_id").collect()]


def test_held_claims(spark):
    assert relations(spark, "click", (1, "assert", 0), (2, "assert", 1), (3, "supersede", 2), (1, "conflict", 3), (3, "repeat", 4), (9, "correct", 5)) == [("FIRST", 1), ("UNKNOWN", 1), ("SUPERSEDE", 3), ("CONFLICT", 3), ("REPEAT", 3), ("CORRECT", 9)]
    assert relations(spark, "signup", (1, "assert", 0), (2, "supersede", 1), (3, "correct", 2)) == [("FIRST", 1), ("CONFLICT", 1), ("CORRECT", 3)]
    assert relations(spark, "view", (1, "assert", 0), (2, "supersede", 1)) == [("FIRST", 1), ("COEXIST", 1)]
    assert relations(spark, "nobody declared it", (1, "assert", 0), (2, "supersede", 1), (2, "correct", 2)) == [("FIRST", 1), ("UNKNOWN", 1), ("CORRECT", 2)]
    assert relations(spark, "click", (1, "assert", 0), (2, "supersede", 0), (3, "supersede", 1), (4, "supersede", 1)) == [("FIRST", 1), ("CONFLICT", 1), ("SUPERSEDE", 3), ("CONFLICT", 3)]


def test_an_undeclared_predicate_is_unknown(spark):
    data = [(i, 1, "favourite colour", datetime(2026, 1, 1 + i), i, "supersede") for i in range(2)]
    assert [r.relation for r in claims.adjacent_relations(spark.createDataFrame(data, DDL)).collect()] == ["UNKNOWN"]


def test_still_inside_a_sentence_is_no_repetition(spark):
    rows = [("He still works there", "assert"), ("again, he works there", "repeat"), ("As I said he left", "repeat"), ("Actually he left", "correct"), ("từ nay anh ấy nghỉ", "supersede"), ("nghe nói anh ấy nghỉ", "conflict")]
    got = spark.createDataFrame(rows, "x string, want string").select("want", T.event_kind(F.col("x")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


@pytest.mark.parametrize(("text", "names"), [
    ("Lương của Bùi Cường là bao nhiêu?", ["Bùi Cường"]), ("Địa chỉ của Bùi Cường?", ["Bùi Cường"]), ("Trước khi sang Bình Minh thì Bùi Cường làm ở đâu", ["Bình Minh", "Bùi Cường"]), ("Huế đẹp", []), ("tôi đi Huế", ["Huế"]), ("đi Huế", ["đi Huế"]),
    ("bùi Cường sống ở đâu", ["bùi Cường"]), ("Trần Hà, Lê Nam", ["Trần Hà", "Lê Nam"]), ("", []), ("anh Nam", ["Nam"]),
])
def test_names(text, names):
    assert planner.name_runs(planner.tidy(text)) == names


def test_one_observation_is_stored_once(spark, tmp_path):
    from tidemark.engine import MemoryEngine

    e = MemoryEngine(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(i, 1, "click", datetime(2026, 1, 1 + i), i, "assert") for i in range(4)], DDL)
    e.observe(rows)
    e.observe(rows.unionByName(rows))
    assert e._read("events").count() == 4 and e.jobs().count() == 4
    e.complete(e.jobs().limit(1))
    assert e.jobs().count() == 3
    row = {"memory_id": 1, "memory_type": "semantic", "epistemic_status": "observed", "verification_status": "unverified", "lifecycle_state": "stable", "trust_tier": 3, "confidence": 0.5, "utility": 0.5, "salience": 0.5, "reinforcement": 0, "contradiction": 0, "content": "unit seven", "source": "user"}
    e.remember(spark.createDataFrame([row]))
    key = spark.createDataFrame([(1,)], "memory_id long")
    e.forget(key)
    assert e.memories().count() == 0
    e.forget(key, restore=True)
    assert e.memories().count() == 1


def test_recall_respects_tenants_and_clearance(spark, tmp_path):
    from tidemark.engine import MemoryEngine

    e = MemoryEngine(spark, f"file://{tmp_path}")
    base = {"memory_type": "semantic", "epistemic_status": "observed", "verification_status": "unverified", "lifecycle_state": "stable", "trust_tier": 3, "confidence": 0.5, "utility": 0.5, "salience": 0.5, "reinforcement": 0, "contradiction": 0, "content": "unit seven uses protocol nine", "source": "user"}
    rows = [base | {"memory_id": 1, "tenant": "a", "workspace": "w", "security_label": "public"}, base | {"memory_id": 2, "tenant": "b", "workspace": "w", "security_label": "public"}, base | {"memory_id": 3, "tenant": "a", "workspace": "v", "security_label": "public"}, base | {"memory_id": 4, "tenant": "a", "workspace": "w", "security_label": "restricted"}]
    e.remember(spark.createDataFrame(rows))
    asked = spark.createDataFrame([(1, "which protocol does unit seven use", "a", "w", "internal")], "item_id long, text string, tenant string, workspace string, most string")
    assert [r.memory_id for r in e.recall(asked).collect()] == [1]


def test_rankings_over_several_passes_and_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    take = lambda df: sorted(map(tuple, df.collect()))
    want = take(matching.bm25(docs, queries, 5)), take(matching.tf_cosine(docs, queries, 5).selectExpr("item_id", "doc_id", "round(cosine, 9)", "overlap")), take(matching.vector_topk(v, v.where("vec_id % 20 = 0"), 3))
    monkeypatch.setattr(matching, "PAIRS", 300)
    monkeypatch.setattr(matching, "CELLS", 3000)
    monkeypatch.setattr(matching, "TOKENS", 2000)
    monkeypatch.setattr(matching, "NUMBERS", 500)
    assert (take(matching.bm25(docs, queries, 5)), take(matching.tf_cosine(docs, queries, 5).selectExpr("item_id", "doc_id", "round(cosine, 9)", "overlap")), take(matching.vector_topk(v, v.where("vec_id % 20 = 0"), 3))) == want


def test_rankings_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "word here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "word"), (2, ""), (3, None)], "item_id long, text string")
    assert matching.bm25(docs, none, 3).count() == 0 and matching.tf_cosine(docs.limit(0), one).count() == 0
    assert [(r.item_id, r.doc_id) for r in matching.bm25(docs, one, 3).collect()] == [(1, 4)]
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [2.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in matching.vector_topk(v, v.where("vec_id = 2"), 1).collect()] == [(2, 4)]
