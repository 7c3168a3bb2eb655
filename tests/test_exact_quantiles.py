"""Quantiles of more rows than an approximate summary holds exactly."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import nearest_rank_time


def times(spark, n):
    """n different times out of order, before 1970 too."""
    return spark.range(n).select(F.expr(f"timestamp_ntz '1969-12-31 23:00:00' + make_dt_interval(0, 0, 0, cast((id * 7919 % {n}) * 0.007 as decimal(18, 6)))").alias("ts"))


@pytest.mark.parametrize("q", [0.4, 0.9])
def test_value_of_the_exact_rank(spark, q):
    n = 3_000_000
    rows = times(spark, n)
    at = nearest_rank_time(rows, "ts", q)
    assert rows.where(F.col("ts") <= at).count() == round(n * q)


def test_few_rows_ties_nulls_and_none(spark):
    rows = spark.sql("SELECT cast(x AS timestamp_ntz) AS ts FROM VALUES ('2024-01-02'), ('2024-01-01'), ('2024-01-02'), (null), ('9999-12-31'), ('0001-01-01') AS t(x)")
    got = spark.range(1).select(*[nearest_rank_time(rows, "ts", q).cast("string").alias(f"q{i}") for i, q in enumerate((0.0, 0.2, 0.4, 0.41, 0.8, 1.0))], nearest_rank_time(rows.where("false"), "ts", 0.5).alias("none")).first()
    assert list(got) == ["0001-01-01 00:00:00", "0001-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00", "9999-12-31 00:00:00", None]
