"""Exact quantiles of any number of rows: the digits of the value are found one after the other, by counting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 13  #: of a digit: a step counts 2 ** BITS groups at most, whatever the rows


def nearest_rank_time(rows: DataFrame, c: str, q: float) -> Column:
    """The value of rank ceil(q * n) of a timestamp_ntz column, as a scalar subquery; nulls don't count, and no row gives null."""
    num, den = Decimal(str(q)).as_integer_ratio()
    r = rows.select(F.col(c).alias("value"), F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', {c})").alias("micros")).where("micros is not null")
    found = r.agg(F.greatest(F.lit(1), F.expr(f"(count(*) * {num} + {den - 1}) div {den}")).alias("rank"))
    for shift in range(-(-64 // BITS) * BITS - BITS, -1, -BITS):
        digits = r.select("value", "micros", F.shiftright("micros", shift).alias("digits"))
        if "digits" in found.columns:  # else the first step, which looks at every row
            so_far = found.select(F.col("digits").alias("so_far"), "rank")
            left = digits.join(F.broadcast(so_far), F.shiftright("digits", BITS) == F.col("so_far"))
        else:
            left = digits.crossJoin(F.broadcast(found))
        counts = left.groupBy("digits", "rank").agg(F.count("*").alias("n"), F.min("value").alias("value"))
        upto = F.sum("n").over(Window.orderBy("digits"))
        found = counts.withColumn("upto", upto).where("rank <= upto and rank > upto - n").select("digits", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "value")
    return found.select("value").scalar()
