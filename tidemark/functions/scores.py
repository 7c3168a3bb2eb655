"""Numeric scores as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L


def lookup(c: Column, table: dict[str, float], default: float = 0.0) -> Column:
    out = reduce(lambda acc, kv: acc.when(c == kv[0], float(kv[1])), list(table.items())[1:], F.when(c == next(iter(table)), float(next(iter(table.values())))))
    return out.otherwise(default)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def durability(access: Column) -> Column:
    return F.least(F.lit(L.L2_DURABILITY), 1 + 0.6 * F.log1p(access))


def l2_decay(memory_type: Column, durable: Column, days: Column) -> Column:
    """exp(-rate/durability * days), the rate by memory type."""
    rate = L.L2_LAMBDA * lookup(memory_type, L.L2_FACTORS, 1.0)
    return F.exp(-rate / clamp(durable, 1.0, L.L2_DURABILITY) * F.greatest(days, F.lit(0.0)))


def exact_strength(authority: Column, confidence: Column, reinforced: Column, days: Column, conflicts: Column, state: Column) -> Column:
    penalty = F.when(state == "conflicting", 0.35).when(state == "superseded", 1.2).otherwise(0.0)
    return 1.1 * authority + confidence + 0.22 * F.log2(reinforced + 1) + 0.35 * F.exp(-0.06 * F.greatest(days, F.lit(0.0))) - 0.18 * conflicts - penalty


def wilson_lower(successes: Column, n: Column, z: float = 1.96) -> Column:
    p = successes / n
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0)


def causal_confidence(support: Column, counter: Column, interventions: Column) -> Column:
    return F.least(F.lit(0.99), (support + 1) / (support + counter + 2) + F.least(0.04 * interventions, F.lit(0.16)))


def backoff(attempts: Column) -> Column:
    return F.least(F.lit(L.BACKOFF_CAP), 2.0 * F.pow(F.lit(2.0), attempts - 1))


def placement(reuse: Column, importance: Column, latency: Column, recompute: Column, relevance: Column, trust: Column) -> Column:
    return 0.24 * reuse + 0.18 * importance + 0.18 * latency + 0.14 * recompute + 0.18 * relevance + 0.08 * trust


def tier(score: Column) -> Column:
    (a, x), (b, y), (c, z) = L.TIERS
    return F.when(score >= a, x).when(score >= b, y).when(score >= c, z).otherwise("archive")


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector is null or zero; products in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
