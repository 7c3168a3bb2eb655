"""Tables in which many rows have the same text, and indexes of more rows than a range's sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import rules as R
from tidemark.sources.stores import VectorIndex


def rows_made(df):
    """The most rows that a step of the plan hands on."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def sides(spark, n):
    d = spark.range(n).select("id", F.lit("x").alias("lang"), F.expr("element_at(array('never keep the old branch', 'you should keep the old branch'), cast(id % 2 + 1 as int))").alias("text"), (F.col("id") % 101 / 100.0).alias("score"))
    return d.where("id % 2 = 0").withColumnRenamed("id", "left_id"), d.where("id % 2 = 1").withColumnRenamed("id", "right_id")


def test_conflicts_meet_by_text_not_by_row(spark):
    left, right = sides(spark, 400)
    pairs = R.text_conflicts(left.drop("score"), right.drop("score"), "lang")
    assert pairs.distinct().count() == 200 * 200 and pairs.where("shared <> 4").count() == 0
    assert rows_made(pairs) <= 200 * 200  # no word of a pair is a row


def test_beliefs_are_dropped_without_pairs(spark):
    left, right = sides(spark, 2000)
    kept = R.kept_beliefs(left, right, "lang")
    assert rows_made(kept) <= 2 * 2000
    assert {r.score for r in kept.collect()} == {1.0}


def test_pages_of_many_vectors(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 3).select((F.col("id") * 7919 % 200_000).alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.upsert(rows)
    assert index.pages(64).where(F.col("page") != F.floor(F.col("vec_id") / 64)).count() == 0
    assert index.pages(64).count() == 200_000
    assert VectorIndex(spark, f"file://{tmp_path}/v").pages(64).where("vec_id < 0").count() == 0
