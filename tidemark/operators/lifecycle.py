"""Rule, fact and approval lifecycles, consolidation and planning helpers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import text as T


def rule_states(signals: DataFrame, threshold: int = 3) -> DataFrame:
    """signals: rule, kind (repeat, challenge, govern), seq, confidence. Confidence and state of each rule after its signals, in order.

    A repetition adds 0.08 (0.99 at most), a challenge takes 0.15 (0.05 at least), governing lifts to 0.68 and adds 0.03. Rules are
    reinforced from two repetitions on, stable from the threshold on. A fold in the JVM over each rule's own signals.
    """
    line = F.array_sort(F.collect_list(F.struct("seq", "kind", "confidence")))
    start = F.struct(F.element_at(F.col("line"), 1)["confidence"].alias("c"), F.lit(0).alias("n"))

    def step(acc, s):
        c = F.when(s["kind"] == "repeat", F.least(F.lit(0.99), acc["c"] + 0.08)).when(s["kind"] == "challenge", F.greatest(F.lit(0.05), acc["c"] - 0.15)).otherwise(F.greatest(F.lit(0.68), acc["c"]) + 0.03)
        return F.struct(c.alias("c"), (acc["n"] + F.when(s["kind"] == "repeat", 1).otherwise(0)).alias("n"))

    done = signals.groupBy("rule").agg(line.alias("line")).withColumn("r", F.aggregate("line", start, step))
    state = F.when(F.col("r.n") >= threshold, "stable").when(F.col("r.n") >= 2, "reinforced").otherwise("proposed")
    return done.select("rule", F.round("r.c", 6).alias("confidence"), F.col("r.n").alias("repeats"), state.alias("state"))


def reconstruction(links: DataFrame, events: DataFrame) -> DataFrame:
    """links: memory_id, event_id, side (source, counter), contradiction. The timeline of each memory's events, each event once; conflict
    says whether the memory has counterevidence or was contradicted."""
    once = links.groupBy("memory_id", "event_id").agg(F.min("side").alias("side"), F.max("contradiction").alias("contradiction"))
    mine = Window.partitionBy("memory_id")
    conflict = F.bool_or((F.col("side") == "counter") | (F.col("contradiction") > 0)).over(mine)
    line = once.withColumn("conflict", conflict).join(events.select("event_id", "ts", "event_type"), "event_id")
    return line.select("memory_id", "event_id", "side", "ts", "event_type", F.row_number().over(mine.orderBy("ts", "event_id")).cast("bigint").alias("position"), "conflict")


def topological(types: dict[str, list[str]]) -> list[str]:
    """Projection types after those they depend on; a cycle is an error."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(t: str) -> None:
        if t in out:
            return
        if t in open_:
            raise ValueError(f"the projections depend on each other in a circle, at {t}")
        open_.add(t)
        for d in sorted(types.get(t, [])):
            visit(d)
        out.append(t)

    for t in sorted(types):
        visit(t)
    return out


def undeclared(declared: set[str], found: set[str]) -> list[str]:
    """Tables that hold content but that no privacy declaration names."""
    return sorted(found - declared)


LAWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "no_overlap": lambda s: s.where("status = 'open'").groupBy("subject", "predicate").count().where("count > 1"),
    "window_order": lambda s: s.where("valid_to < valid_from"),
    "corrected_is_empty": lambda s: s.where("status = 'corrected' and valid_to <> valid_from"),
    "disputed_never_closes": lambda s: s.where("disputed and valid_to is not null"),
    "superseded_is_closed": lambda s: s.where("status = 'superseded' and valid_to is null"),
    "confirmations_count": lambda s: s.where("confirmations < 0"),
}


def constitution(history: DataFrame) -> DataFrame:
    """Violations of each law that a claim history must keep."""
    out = None
    for name, law in LAWS.items():
        row = law(history).agg(F.count("*").alias("violations")).select(F.lit(name).alias("law"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def when_of(c):
    """The date a question names: ISO, then d/m/y, then a year; null if none."""
    iso, dmy, year = (F.regexp_extract(c, p, 0) for p in (r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b(19|20)\d{2}\b"))
    return F.when(iso != "", F.try_to_date(iso)).when(dmy != "", F.try_to_date(dmy, "d/M/yyyy")).when(year != "", F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


ROUTES = (("ever", L.EVER), ("temporal", L.TEMPORAL), ("class", L.SELF_HISTORY))


def route(c):
    """Which operator a question goes to first: existence, temporal, class, else recall."""
    out = None
    for name, p in ROUTES:
        hit = c.rlike("(?iU)" + p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("recall")


tokens = T.tokens
