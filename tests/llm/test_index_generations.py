"""The index of exact deduplication when tasks pass entries on many times."""

from __future__ import annotations

import hashlib
from collections import Counter

from tidemark.llm import exact_dedup

N, TEXTS = 300, 40


def test_one_entry_a_digest_however_often_tasks_emit(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "EMIT", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.range(N).selectExpr("id AS doc_id", f"concat('text ', id % {TEXTS}) AS text").repartition(6)
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
        marks = exact_dedup.exact_dedup(docs).count()
        left = [r.doc_id for r in exact_dedup.deduplicated(docs).collect()]
        digests = docs.selectExpr("unhex(sha2(text, 256)) AS digest", "doc_id")
        index = Counter((bytes(r.digest), r.keep_id, r.ties, r.group_size) for r in exact_dedup.build_index(digests, 32).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = lambda t: len(range(t, N, TEXTS))
    assert marks == N
    assert all((r.keep_id, r.group_size, r.kept) == (i % TEXTS, size(i % TEXTS), i < TEXTS) for i, r in got.items())
    assert sorted(left) == list(range(TEXTS))
    assert index == Counter((hashlib.sha256(f"text {t}".encode()).digest(), t, 1, size(t)) for t in range(TEXTS))
