"""Deals rows out by ranges of doc_id, with cut points that are fixed before the text is read."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_ends(docs: DataFrame, n: int) -> np.ndarray:
    """Ascending identifiers, each the largest of its range; all occur in the table, the last is its maximum. At most n.

    Reads the identifiers alone; a quantile sketch of bounded size goes to the driver.
    """
    shares = ", ".join(f"{i / n:.9f}D" for i in range(1, n))
    cuts = f"percentile_approx(doc_id, array({shares}), {max(10_000, 8 * n)})" if n > 1 else "array()"
    row = docs.agg(F.expr(cuts).alias("cuts"), F.max("doc_id").alias("top")).first()
    return np.unique(np.array([*(row.cuts or []), row.top], np.int64)) if row.top is not None else np.zeros(0, np.int64)


def packed(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)
