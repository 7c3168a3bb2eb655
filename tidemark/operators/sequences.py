"""Window operators over ordered rows: trailing frames, streaks, novelty, trimming, coverage trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import scores as S


def homeostasis(rows: DataFrame, by: str, order: list[str], frame: int = 12) -> DataFrame:
    """rows: by, order, unresolved, severity. Stress and weights from the last `frame` rows, and the length of the failure streak that ends at each row.

    The streak is the rows since the last success within the frame; in one window sort, without collecting the frame.
    """
    w = Window.partitionBy(by).orderBy(*order)
    last = w.rowsBetween(-(frame - 1), 0)
    n = F.row_number().over(w)
    failed = (F.col("unresolved") >= 0.5) | (F.col("severity") >= 0.75)
    calm = F.last(F.when(~failed, n), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    streak = F.least(n - F.coalesce(calm, F.lit(0)), F.lit(frame))
    out = rows.withColumn("n", n).withColumn("streak", streak.cast("int")).withColumn("u", F.avg("unresolved").over(last)).withColumn("s", F.avg("severity").over(last))
    stress = F.round(S.clamp(0.45 * F.col("u") + 0.35 * F.col("s") + 0.20 * F.least(F.col("streak") / 5.0, F.lit(1.0))) + 1e-9, 6)
    out = out.withColumn("stress", stress)
    raw = {"severity": 0.15 + 0.20 * F.col("stress"), "unresolved": 0.20 + 0.10 * F.col("stress"), "recency": F.greatest(F.lit(0.05), 0.15 - 0.05 * F.col("stress")), "novelty": F.greatest(F.lit(0.10), 0.20 - 0.05 * F.col("stress"))}
    rest = sum(raw.values(), F.lit(0.0))
    task = F.greatest(F.lit(0.15), 1 - rest)
    return out.select(by, *order, "streak", "stress", F.round(1 + F.col("stress"), 3).alias("gain"), F.round(task / (task + rest), 6).alias("task_weight"))


def novelty(rows: DataFrame, by: str, order: list[str], frame: int = 20) -> DataFrame:
    """rows: by, order, source, topic. 0.9 less 0.2 for each of the last `frame` rows of the same source and topic."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-frame, -1)
    seen = F.collect_list(F.struct("source", "topic")).over(w)
    alike = F.size(F.filter(seen, lambda x: (x["source"] == F.col("source")) & (x["topic"] == F.col("topic"))))
    return rows.withColumn("seen", seen).select(by, *order, F.round(S.clamp(0.9 - 0.2 * alike), 6).alias("novelty"))


def trimmed(rows: DataFrame, by: str, most: int, order: list) -> DataFrame:
    """The best `most` rows of each group; the rank limit is applied before the shuffle too."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def coverage_leaves(rows: DataFrame, by: str, order: list[str], size: int = 6) -> DataFrame:
    """Runs of `size` rows, numbered from 0."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("leaf", F.floor((n - 1) / size).cast("long"))


def coverage_levels(leaves: DataFrame, by: str, levels: int, size: int = 6) -> DataFrame:
    """leaves: by, leaf, n (rows covered). Each level groups `size` nodes of the one below."""
    level, out = leaves.select(by, F.lit(0).alias("level"), F.col("leaf").alias("node"), "n"), None
    out = level
    for i in range(1, levels + 1):
        level = level.groupBy(by, F.floor(F.col("node") / size).cast("long").alias("node")).agg(F.sum("n").alias("n")).select(by, F.lit(i).alias("level"), "node", "n")
        out = out.unionByName(level)
    return out


def sessions(rows: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    return rows.groupBy(by, F.session_window(F.col(at).cast("timestamp"), gap)).agg(F.count("*").alias("n"))


WEIGHTS = L.BASE_WEIGHTS
