"""Evaluation worlds: a seeded generator of a life's statements, answerers that are right and wrong in known ways, and whether a
benchmark can tell them apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: odds of what happens next to a slot with a value, and limits of the integrity report
IMMUTABLE_ODDS = ((0.70, "repeat"), (0.85, "correct"), (1.0, "noise"))
ASSERTED, REPEATED, CHANGED, NOISY, CONTRADICTED, CORRECTED, FORGOTTEN = 0.85, 0.28, 0.26, 0.62, 0.72, 0.80, 0.84
FORGET_FROM = 0.25
SAMPLE, SKEW, EVENTS, PERFECT, APART = 8, 0.85, 10, 0.95, 0.15
SENTENCES = {"assert": "% là $.", "repeat": "Nhắc lại, % là $.", "supersede": "Từ hôm nay, % là $.", "correct": "Đính chính: % là $.", "contradict": "Theo một nguồn khác, % là $.", "forget": "Hãy quên %.", "noise": "Hôm nay trời đẹp."}


def roll(seed: int, what: str, tick: Column) -> Column:
    """A number from [0, 1) of 52 bits, from the md5 of the seed, a name and the tick."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{what}|"), tick.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def world(spark: SparkSession, ticks: int, slots: int, immutable: int, seed: int) -> DataFrame:
    """tick, slot, kind, value, text. Each tick touches one slot; every `immutable`th slot never changes. What happens depends on
    whether the slot has a value: a fold over each slot's own ticks, in the JVM."""
    t = F.col("id")
    rows = spark.range(1, ticks + 1).select(t.alias("tick"), F.floor(roll(seed, "slot", t) * slots).cast("int").alias("slot"), roll(seed, "kind", t).alias("r"), F.floor(roll(seed, "value", t) * 9).cast("int").alias("v"))
    line = F.array_sort(F.collect_list(F.struct("tick", "r", "v")))
    none = F.struct(F.lit(False).alias("has"), F.array().cast("array<struct<tick bigint, kind string, v int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        progress = x["tick"] / ticks
        fixed = None
        for edge, kind in IMMUTABLE_ODDS:
            fixed = F.when(x["r"] < edge, kind) if fixed is None else fixed.when(x["r"] < edge, kind)
        moving = (F.when(x["r"] < REPEATED, "repeat").when(x["r"] < REPEATED + CHANGED * progress, "supersede").when(x["r"] < NOISY, "noise").when(x["r"] < CONTRADICTED, "contradict").when(x["r"] < CORRECTED, "correct")
                  .when((x["r"] < FORGOTTEN) & (progress > FORGET_FROM), "forget").otherwise("repeat"))
        kind = F.when(~acc["has"], F.when(x["r"] < ASSERTED, "assert").otherwise("noise")).when(x["still"], fixed).otherwise(moving)
        has = F.when(kind == "forget", False).when(kind == "assert", True).otherwise(acc["has"])
        return F.struct(has.alias("has"), F.array_append(acc["out"], F.struct(x["tick"].alias("tick"), kind.alias("kind"), x["v"].alias("v"))).alias("out"))

    still = F.col("slot") % immutable == 0
    marked = rows.groupBy("slot").agg(line.alias("line")).withColumn("line", F.transform("line", lambda x: F.struct(x["tick"].alias("tick"), x["r"].alias("r"), x["v"].alias("v"), still.alias("still"))))
    got = marked.select("slot", F.explode(F.aggregate("line", none, step)["out"]).alias("e")).select("e.tick", "slot", "e.kind", F.col("e.v").alias("value"))
    sentence = None
    for kind, s in SENTENCES.items():
        sentence = F.when(F.col("kind") == kind, s) if sentence is None else sentence.when(F.col("kind") == kind, s)
    text = F.replace(F.replace(sentence, F.lit("%"), F.concat(F.lit("slot "), F.col("slot").cast("string"))), F.lit("$"), F.col("value").cast("string"))
    return got.withColumn("text", text)


def truth(events: DataFrame) -> DataFrame:
    """slot, value (null: forgotten or never known), first, latest, changed, over the whole world. Repetitions say what holds, so they
    carry no value of their own; hearsay never holds."""
    sets = events.where(F.col("kind").isin("assert", "supersede", "correct", "forget"))
    last = sets.groupBy("slot").agg(F.max_by(F.when(F.col("kind") != "forget", F.col("value")), "tick").alias("value"), F.max_by("kind", "tick").alias("kind"))
    told = events.where(F.col("kind").isin("assert", "supersede", "correct", "contradict"))
    seen = told.groupBy("slot").agg(F.min_by("value", "tick").alias("first"), F.max_by("value", "tick").alias("latest"), F.count_if(F.col("kind") == "supersede").alias("changed"))
    return seen.join(last.select("slot", F.when(F.col("kind") != "forget", F.col("value")).alias("value")), "slot", "left")


ANSWERERS = {
    "perfect": lambda: F.col("value"), "first_value": lambda: F.col("first"), "latest_mention": lambda: F.col("latest"), "never_declines": lambda: F.coalesce("value", "latest"), "always_declines": lambda: F.lit(None).cast("int"), "plausible_wrong": lambda: (F.coalesce("value", F.lit(0)) + 1) % 9,
}


def scored(questions: DataFrame) -> DataFrame:
    """questions: slot, value, first, latest. answerer, score: the share of questions each answers as the ledger does."""
    shares = [questions.agg(F.round(F.avg(a().eqNullSafe(F.col("value")).cast("int")), 6).alias("score")).select(F.lit(name).alias("answerer"), "score") for name, a in ANSWERERS.items()]
    return reduce(DataFrame.unionByName, shares)


def integrity(questions: DataFrame, events: DataFrame, scores: DataFrame) -> DataFrame:
    """questions: family, expect. Warnings (check, subject, figure): samples too small or of one answer, kinds of events too rare, a
    right answerer that isn't, wrong ones that come too near."""
    per = questions.groupBy("family").agg(F.count("*").alias("n"))
    small = per.where(F.col("n") < SAMPLE).select(F.lit("small_family").alias("check"), F.col("family").alias("subject"), F.col("n").cast("double").alias("figure"))
    top = questions.groupBy("family", "expect").agg(F.count("*").alias("k")).groupBy("family").agg(F.max("k").alias("k"), F.sum("k").alias("n"))
    skewed = top.where((F.col("n") >= SAMPLE) & (F.col("k") / F.col("n") > SKEW)).select(F.lit("skewed_family").alias("check"), F.col("family").alias("subject"), F.round(F.col("k") / F.col("n"), 6).alias("figure"))
    counts = events.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("repeat", "supersede", "correct", "forget")])
    rare = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("subject"), F.col(k).alias("n")) for k in ("repeat", "supersede", "correct", "forget")])).alias("x")).where(F.col("x.n") < EVENTS).select(F.lit("rare_event").alias("check"), "x.subject", F.col("x.n").cast("double").alias("figure"))
    best = F.max(F.when(F.col("answerer") == "perfect", F.col("score"))).over(Window.partitionBy(F.lit(1)))  # one row an answerer
    s = scores.withColumn("best", best)
    unreachable = s.where((F.col("answerer") == "perfect") & (F.col("score") < PERFECT)).select(F.lit("unreachable").alias("check"), F.col("answerer").alias("subject"), F.col("score").alias("figure"))
    near = s.where((F.col("answerer") != "perfect") & (F.col("best") - F.col("score") < APART)).select(F.lit("too_near").alias("check"), F.col("answerer").alias("subject"), F.round(F.col("best") - F.col("score"), 6).alias("figure"))
    return reduce(DataFrame.unionByName, [small, skewed, rare, unreachable, near])


def naive_rag(hits: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """hits: item_id, doc_id, rank. questions: item_id, answer. The baseline that has no memory: does any retrieved text hold the
    answer? item_id, hit, first_rank."""
    j = questions.join(hits, "item_id", "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    found = F.lower("text").contains(F.lower("answer"))
    return j.groupBy("item_id").agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("hit"), F.min(F.when(found, F.col("rank"))).alias("first_rank"))
