"""Aggregates of evaluations, services and belief stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import scores as S


def nearest_rank(q: float, c: str) -> Column:
    """The exact percentile that is a value of the data."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})")


def index_percentile(values: Column, q: float) -> Column:
    """values: sorted array. The element at int(n * q), the last one at most."""
    at = F.least(F.floor(F.size(values) * q).cast("int"), F.size(values) - 1)
    return F.element_at(values, at + 1)


def log_bucket(c: Column, per_decade: int = 50) -> Column:
    return F.floor(F.log10(F.greatest(c, F.lit(1e-9))) * per_decade).cast("long")


def histogram(rows: DataFrame, by: list[str], c: str) -> DataFrame:
    """Counts by logarithmic bucket: partial histograms merge by adding."""
    return rows.groupBy(*by, log_bucket(F.col(c)).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, by: list[str], q: float, per_decade: int = 50) -> DataFrame:
    """Upper edge of the bucket that holds the q-th value, from a histogram of any size."""
    w = Window.partitionBy(*by).orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy(*by))
    run = hist.withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", total)
    hit = run.where(F.col("run") >= F.ceil(F.lit(q) * F.col("total")))
    return hit.groupBy(*by).agg(F.min("bucket").alias("bucket")).withColumn("value", F.round(F.pow(F.lit(10.0), (F.col("bucket") + 1) / per_decade), 6))


def capability(runs: DataFrame, by: list[str], risk: str = "medium") -> DataFrame:
    """runs: by, success (boolean). Counts, rate, Wilson lower bound and whether to delegate at the risk."""
    g = runs.groupBy(*by).agg(F.count_if("success").alias("successes"), F.count("*").alias("n"))
    low = F.round(S.wilson_lower(F.col("successes"), F.col("n")), 6)
    return g.withColumn("rate", F.round(F.col("successes") / F.col("n"), 6)).withColumn("lower", low).withColumn("delegate", (F.col("n") < 3) | (F.col("lower") < L.DELEGATION[risk]))


def token_f1(pairs: DataFrame, key: list[str]) -> DataFrame:
    """pairs: key, want, got (arrays of tokens). Multiset F1 and exact match: a token counts as often as both have it."""
    a = pairs.select(*key, F.explode("want").alias("t")).groupBy(*key, "t").agg(F.count("*").alias("x"))
    b = pairs.select(*key, F.explode("got").alias("t")).groupBy(*key, "t").agg(F.count("*").alias("y"))
    shared = a.join(b, [*key, "t"]).groupBy(*key).agg(F.sum(F.least("x", "y")).alias("common"))
    both = pairs.join(shared, key, "left").withColumn("common", F.coalesce("common", F.lit(0)))
    p, r = F.try_divide("common", F.size("got")), F.try_divide("common", F.size("want"))
    f1 = F.when((F.size("got") == 0) | (F.size("want") == 0), (F.size("got") == F.size("want")).cast("double")).when(F.col("common") == 0, 0.0).otherwise(2 * p * r / (p + r))
    return both.select(*key, F.round(f1, 6).alias("f1"), (F.col("want") == F.col("got")).alias("exact"))


def procedures(traces: DataFrame, least: int = 2, most_failures: float = 0.25) -> DataFrame:
    """traces: goal, steps (string), success. The modal step sequence of each goal with enough equal successes and few failures."""
    ok = traces.where("success").groupBy("goal", "steps").agg(F.count("*").alias("support"))
    w = Window.partitionBy("goal").orderBy(F.desc("support"), "steps")
    best = ok.withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) & (F.col("support") >= least)).drop("n")
    total = traces.groupBy("goal").agg(F.count_if("success").alias("s"), F.count_if(~F.col("success")).alias("f"))
    j = best.join(total, "goal").where((F.col("s") >= 2) & (F.col("f") / (F.col("s") + F.col("f")) <= most_failures))
    return j.select("goal", "steps", "support", F.round(F.least(F.lit(0.95), 0.55 + 0.10 * F.col("s") - 0.30 * F.col("f")), 6).alias("confidence"), (F.col("s") >= 4).alias("stable"))


def drift(points: DataFrame, by: list[str]) -> DataFrame:
    """points: by, elapsed, value. Means of the first and last window (an hour, or a third of the span), their difference, absolute and by hour."""
    span = Window.partitionBy(*by)
    lo, hi = F.min("elapsed").over(span), F.max("elapsed").over(span)
    p = points.withColumn("lo", lo).withColumn("hi", hi).withColumn("w", F.least(F.lit(3600.0), (F.col("hi") - F.col("lo")) / 3))
    g = p.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("elapsed") <= F.col("lo") + F.col("w"), F.col("value"))), 6).alias("first"), F.round(F.avg(F.when(F.col("elapsed") >= F.col("hi") - F.col("w"), F.col("value"))), 6).alias("last"), F.max(F.col("hi") - F.col("lo")).alias("span"))
    d = F.round(F.col("last") - F.col("first"), 6)
    return g.where("n >= 4").select(*by, "n", "first", "last", d.alias("drift"), F.round(F.try_divide(d * 3600, F.col("span")), 6).alias("per_hour"))


def objectives(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """measured: metric, value. rules: metric, op, wanted. pass, fail or not_measured of every rule."""
    j = rules.join(measured, "metric", "left")
    ok = F.when(F.col("op") == "lte", F.col("value") <= F.col("wanted")).otherwise(F.col("value") >= F.col("wanted"))
    return j.select("metric", "wanted", F.round("value", 6).alias("value"), F.when(F.col("value").isNull(), "not_measured").when(ok, "pass").otherwise("fail").alias("verdict"))


def evidence(links: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """links: by, event_id, side (support or counter). events: event_id, tier, source. Ratio, corroboration and score of each claim."""
    j = links.join(events, "event_id", "left")
    weight = F.coalesce("tier", F.lit(0)) + 1  # sixths; whole numbers keep the sums exact
    g = j.groupBy(by).agg(
        F.sum(F.when(F.col("side") == "support", weight).otherwise(0)).alias("pro"), F.sum(F.when(F.col("side") == "counter", weight).otherwise(0)).alias("con"),
        F.count_distinct(F.when(F.col("side") == "support", F.col("source"))).alias("sources"))
    ratio = F.coalesce(F.try_divide("pro", F.col("pro") + F.col("con")), F.lit(0.0))
    corroboration = F.least(F.lit(0.24), 0.08 * F.greatest(F.lit(0), F.col("sources") - 1))
    return g.select(by, F.round(ratio, 6).alias("ratio"), "sources", F.round(S.clamp(0.30 * 0.5 + 0.40 * ratio + corroboration), 6).alias("score"))
