"""Forgetting: versions and their restoration, what a request is about, what goes at each level, and proof that nothing is left."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tidemark.operators import planner as P

# fixed values: words of a request that name nothing
BOILERPLATE = {
    "hãy", "xin", "làm", "ơn", "quên", "xoá", "xóa", "bỏ", "huỷ", "hủy", "thông", "tin", "dữ", "liệu", "mọi", "hết", "tất", "cả", "về", "của", "liên", "quan", "tới", "đến", "đi", "cái", "chuyện", "thứ", "những",
    "please", "forget", "delete", "remove", "erase", "all", "about", "everything", "data", "information", "the", "my", "any",
}
TITLES = {"anh", "chị", "em", "ông", "bà", "cô", "chú", "bác", "khách", "hàng", "mr", "mrs", "ms", "sir"}
UNAPPLIED = ("pending", "in_progress", "failed", "dead_letter", "dead")
PROBE, PROBE_TOKEN, PROBES = 8, 6, 8  #: characters of a text and of a word that prove something; probes of a memory
ERASED = "[ERASED]"
#: what a level removes: the memory itself; what was made of it; the log it came from
LEVELS = {"projection": ("memories",), "derived": ("memories", "embeddings", "labels", "consolidated"), "history": ("memories", "embeddings", "labels", "consolidated", "events")}


def folded(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def mentions(content: Column, subject: Column) -> Column:
    """Whether every word of the subject stands in the content, as a part of words too. An empty subject is in all."""
    low = folded(content)
    return F.forall(F.regexp_extract_all(folded(subject), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1)), lambda w: F.contains(low, w))


def request(text: str | None) -> tuple[str | None, str | None]:
    """(subject, topic): the longest run of capitalised words, and the words that are left."""
    whole = P.tidy(text)
    runs: list[list[str]] = [[]]
    for token in re.findall(r"[\w./-]+", whole):
        if token[0].isupper() and token.lower() not in TITLES | BOILERPLATE:
            runs[-1].append(token)
        elif runs[-1]:
            runs.append([])
    subject = max(runs, key=len)
    skip = BOILERPLATE | TITLES | set(re.findall(r"\w+", " ".join(subject).lower()))
    left = [w for w in re.findall(r"\w+", whole.lower()) if w not in skip and len(w) > 1]
    return " ".join(subject) or None, " ".join(left) or None


@F.pandas_udf(Ty.StructType([Ty.StructField("subject", Ty.StringType()), Ty.StructField("topic", Ty.StringType())]))
def scope(texts: pd.Series) -> pd.DataFrame:
    """What requests to forget are about: a scan with state, so it isn't a regular expression."""
    return pd.DataFrame([request(t) for t in texts], columns=["subject", "topic"])


def acted(versions: DataFrame, actions: DataFrame) -> DataFrame:
    """versions: memory_id, version, state, forgotten_at. actions: memory_id, action (supersede, forget, restore), at. The versions
    with one appended for each action, in order; nothing is rewritten. A restored memory has the state it had before."""
    from pyspark.sql import Window

    base = versions.groupBy("memory_id").agg(F.max("version").alias("last"), F.max_by("state", "version").alias("was"))
    line = Window.partitionBy("memory_id").orderBy("at", "action")
    steps = actions.join(base, "memory_id").withColumn("version", (F.col("last") + F.row_number().over(line)).cast(versions.schema["version"].dataType))
    # what is true of the memory itself, apart from being forgotten: superseded from the first such action on
    superseded = F.max((F.col("action") == "supersede").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)) == 1
    state = F.when(F.col("action") == "forget", "forgotten").when(superseded, "superseded").otherwise(F.col("was"))
    new = steps.select("memory_id", "version", state.alias("state"), F.when(F.col("action") == "forget", F.col("at")).alias("forgotten_at"))
    return versions.select("memory_id", "version", "state", "forgotten_at").unionByName(new)


def newest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("memory_id").agg(F.max("version").alias("version"), F.max_by("state", "version").alias("state"), F.max_by("forgotten_at", "version").alias("forgotten_at"))


def targets(memories: DataFrame, subject: str) -> DataFrame:
    """memory_id of the memories that mention a subject."""
    return memories.where(mentions(F.col("content"), F.lit(subject))).select("memory_id")


def erased(stores: dict[str, tuple], gone: DataFrame, level: str) -> dict[str, DataFrame]:
    """stores: name -> (rows, key column of the memory[, key of the row]). The stores without what the level removes. Where the
    key is an array of source memories, a row goes if any of them does, and the row's own key is needed. Other stores are returned
    as they are."""
    out = {}
    for name, (rows, key, *own) in stores.items():
        if name not in LEVELS[level]:
            out[name] = rows
        elif own:
            hit = rows.select(own[0], F.explode(key).alias("memory_id")).join(gone, "memory_id", "left_semi").select(own[0]).distinct()
            out[name] = rows.join(hit, own[0], "left_anti")
        else:
            out[name] = rows.join(gone.select(F.col("memory_id").alias(key)), key, "left_anti")
    return out


def residue(stores: dict[str, tuple[DataFrame, str]], needle: str) -> DataFrame:
    """stores: name -> (rows, text column). store, residue (rows whose folded text still holds the folded needle), checked. An empty
    needle proves nothing: checked is 0."""
    want = " ".join(needle.split()).lower()
    parts = [rows.agg(F.count_if(folded(F.col(c)).contains(want)).alias("residue"), F.count("*").alias("checked")).select(F.lit(name).alias("store"), F.when(F.lit(bool(want)), F.col("residue")).otherwise(0).alias("residue"), F.when(F.lit(bool(want)), F.col("checked")).otherwise(0).alias("checked")) for name, (rows, c) in stores.items()]
    return reduce(DataFrame.unionByName, parts)


def purged(stores: dict[str, DataFrame], tenant: str, workspace: str) -> dict[str, DataFrame]:
    """All stores without a workspace of a tenant; rows of no workspace are shared and stay."""
    gone = (F.col("tenant") == tenant) & F.col("workspace").eqNullSafe(workspace)
    return {name: rows.where(~F.coalesce(gone, F.lit(False))) for name, rows in stores.items()}


def probes(content: Column) -> Column:
    """Strings that must not be found once a memory is gone: its text, if long enough, and its long words; a bounded number."""
    text = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    whole = F.when(F.length(text) >= PROBE, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(whole, F.regexp_extract_all(text, F.lit(rf"(\S{{{PROBE_TOKEN},}})"), F.lit(1)))), 1, PROBES)


def in_flight(outbox: DataFrame, events: DataFrame, needle: str) -> DataFrame:
    """event_id of events that hold the needle and whose projection is still owed: forgetting must stop them too."""
    held = events.where(folded(F.col("payload")).contains(" ".join(needle.split()).lower())).select("event_id")
    return outbox.where(F.col("status").isin(*UNAPPLIED)).select("event_id").distinct().join(held, "event_id", "left_semi")


def redacted(payload: Column, needle: str) -> Column:
    return F.regexp_replace(payload, "(?iu)" + re.escape(needle), ERASED)


def by_predicate(memories: DataFrame, wanted: str) -> DataFrame:
    """Adds verdict: match (the content speaks of the wanted predicate), other, or abstained (of none that is known)."""
    found, _, _ = P.predicate(F.col("content"))
    return memories.withColumn("verdict", F.when(found == wanted, "match").when(found == "unknown", "abstained").otherwise("other"))
