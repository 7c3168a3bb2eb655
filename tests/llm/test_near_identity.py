"""Removal of near copies where doc_ids are null or repeat."""

from __future__ import annotations

from tidemark.llm.jaccard_join import without_near_copies

WORDS = {c: [f"{c}{i}" for i in range(60)] for c in "abcde"}
text = lambda c, *changed: " ".join(w if i not in changed else "changed" for i, w in enumerate(WORDS[c]))
DDL = "doc_id long, text string, source string"


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, f"row {n}") for n, (i, t) in enumerate(rows)], DDL).repartition(3)
    return sorted(int(r.source.split()[1]) for r in without_near_copies(docs).collect())


def test_other_texts_of_a_dropped_id_stay(spark):
    rows = [(3, text("a")), (None, text("a", 0)), (None, text("b")), (None, text("c")), (5, text("d")), (7, text("d", 59)), (7, text("e")), (9, ""), (None, None)]
    assert left(spark, rows) == [0, 2, 3, 4, 6, 7, 8]


def test_one_of_near_copies_that_share_an_id_stays(spark):
    rows = [(None, text("a")), (None, text("a", 0)), (2, text("b")), (2, text("b", 59)), (8, text("b", 0)), (4, text("c")), (4, text("d"))]
    got = left(spark, rows)
    assert len(got) == 4 and len({0, 1} & set(got)) == 1 and len({2, 3} & set(got)) == 1 and {5, 6} <= set(got)


def test_groups_that_share_their_smallest_id_are_kept_apart(spark):
    rows = [(1, text("a")), (2, text("a", 0)), (1, text("b")), (3, text("b", 0)), (None, text("c")), (None, text("d"))]
    assert left(spark, rows) == [0, 2, 4, 5]


def test_one_row_of_texts_that_differ_in_case_stays(spark):
    rows = [(1, text("a")), (1, text("a").upper()), (1, text("a")), (6, text("b"))]
    assert left(spark, rows) in ([1, 3],)
