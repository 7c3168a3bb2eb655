"""Running the engine: schema and log checks, audit cursors, repairs that check again, replays, queue views, comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import lexicon as L
from tidemark.functions.text import content_hash

DOCTOR_VERSION = 3
#: a projection waits for those of its event that it depends on
DEPENDS = {"label": "memory"}
# fixed values: weights of the faults a benchmark injects
FAULTS = (("normal", 0.80), ("transient", 0.08), ("stale_lease", 0.04), ("dependency", 0.03), ("skipped", 0.02), ("permanent", 0.02), ("duplicate", 0.01))


def schema_report(spark: SparkSession, tables: dict[str, DataFrame | None], wanted: dict[str, str]) -> DataFrame:
    """table_name, column_name, problem: what is missing or has another type than declared (DDL). Reads no data."""
    out = []
    for name, ddl in wanted.items():
        rows = tables.get(name)
        if rows is None:
            out.append((name, None, "missing_table"))
            continue
        have = {f.name: f.dataType for f in rows.schema}
        for f in StructType.fromDDL(ddl):
            if f.name not in have:
                out.append((name, f.name, "missing_column"))
            elif have[f.name] != f.dataType:
                out.append((name, f.name, f"is_{have[f.name].simpleString()}"))
    return spark.createDataFrame(out, "table_name string, column_name string, problem string")


def log_faults(events: DataFrame) -> DataFrame:
    """Events that share an identifier, or lack their checksum: code, event_id, n."""
    doubles = events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_event").alias("code"), "event_id", "n")
    bare = events.where(F.coalesce("checksum", F.lit("")) == "").groupBy("event_id").agg(F.count("*").alias("n")).select(F.lit("missing_checksum").alias("code"), "event_id", "n")
    return doubles.unionByName(bare)


def fingerprint(schema: StructType) -> str:
    """Changes with any column's name, type or place."""
    import hashlib

    return hashlib.sha256(schema.json().encode()).hexdigest()[:32]


def cursors(stored: DataFrame, seen: DataFrame, version: int, print_: str) -> DataFrame:
    """stored: scope, last_id, doctor_version, schema_fingerprint. seen: scope, top_id, findings. Where each scope's next audit
    starts, and why: a cursor of another doctor or schema is discarded, one with open findings stays where it is."""
    both = seen.join(stored, "scope", "left")
    fresh = F.when(F.col("last_id").isNull(), "none_stored").when(F.col("doctor_version") != version, "discarded_version").when(F.col("schema_fingerprint") != print_, "discarded_schema")
    held = F.coalesce("findings", F.lit(0)) > 0
    reason = F.coalesce(fresh, F.when(held, "held_by_findings").otherwise("advanced"))
    start = F.when(fresh.isNotNull(), 0).otherwise(F.col("last_id"))
    return both.select("scope", reason.alias("reason"), start.cast("bigint").alias("start_id"), F.when(held, start).otherwise(F.greatest(start, F.col("top_id"))).cast("bigint").alias("next_id"))


def owed_key() -> Column:
    return content_hash(F.col("event_id").cast("string"), F.col("projection_type"))


def repaired(plan: DataFrame, outbox: DataFrame, ledger: DataFrame) -> DataFrame:
    """plan: code, job_id. What each repair finds when its job is looked at again: code, job_id, applied, status (after it), key.
    A repair whose precondition no longer holds changes nothing. Codes that no recipe names are refused."""
    built = ledger.select("event_id", "projection_type", F.lit(True).alias("built")).distinct()
    now = plan.join(outbox, "job_id", "left").join(built, ["event_id", "projection_type"], "left").withColumn("built", F.coalesce("built", F.lit(False)))
    is_ = lambda s: F.col("status") == s
    recipes = {
        "stale_lease": (is_("in_progress"), F.lit("pending")), "in_progress_without_owner": (is_("in_progress"), F.lit("pending")), "attempts_exhausted": (~is_("dead"), F.lit("dead")),
        "completed_without_projection": (is_("completed") & ~F.col("built"), F.lit("pending")), "skipped_with_ledger": (is_("skipped") & F.col("built"), F.lit("completed")), "key_mismatch": (F.col("projection_key") != owed_key(), F.col("status")),
    }
    ok, status = F.lit(False), F.col("status")
    for code, (still, new) in recipes.items():
        mine = F.col("code") == code
        ok, status = F.when(mine, F.coalesce(still, F.lit(False))).otherwise(ok), F.when(mine & F.coalesce(still, F.lit(False)), new).otherwise(status)
    known = F.col("code").isin(*recipes)
    key = F.when((F.col("code") == "key_mismatch") & ok, owed_key()).otherwise(F.col("projection_key"))
    return now.select("code", "job_id", F.when(~known, "refused").when(ok, "applied").otherwise("stale").alias("outcome"), status.alias("status"), key.alias("projection_key"))


def replayed(owed: DataFrame, tombstones: DataFrame, replayable: tuple[str, ...]) -> DataFrame:
    """owed: event_id, projection_type, state (of replay_scan). What a replay would do with each: verdict."""
    dead = tombstones.select("event_id", F.lit(True).alias("buried")).distinct()
    parents = owed.select("event_id", F.col("projection_type").alias("parent"), F.col("state").alias("parent_state"))
    needs = F.create_map(*[F.lit(x) for kv in DEPENDS.items() for x in kv])
    rows = owed.withColumn("parent", needs[F.col("projection_type")]).join(parents, ["event_id", "parent"], "left").join(dead, "event_id", "left")
    verdict = (F.when(F.col("state") == "done", "done").when(F.col("buried"), "skipped_tombstoned").when(~F.col("projection_type").isin(*replayable), "skipped_unreplayable")
               .when(F.col("parent").isNotNull() & (F.coalesce("parent_state", F.lit("missing")) != "done"), "held_by_dependency").otherwise("replay"))
    return rows.select("event_id", "projection_type", "state", verdict.alias("verdict"))


def reset(outbox: DataFrame, jobs: DataFrame) -> DataFrame:
    """The outbox with the given jobs (job_id) pending again, from the first attempt and without an owner."""
    hit = outbox.join(jobs.select("job_id", F.lit(True).alias("again")).distinct(), "job_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    none = lambda c: F.when(~F.col("again"), F.col(c)).alias(c)
    return hit.select(*[F.when(F.col("again"), F.lit("pending")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(F.col("again"), F.lit(0)).otherwise(F.col(c)).alias(c) if c == "attempts" else none(c) if c in ("locked_by", "locked_at", "last_error", "completed_at") else F.col(c) for c in outbox.columns])


def queue_views(outbox: DataFrame, now: float, lease: float) -> DataFrame:
    """view, job_id: pending, dead and stale jobs."""
    views = {"pending": F.col("status") == "pending", "dead_letter": F.col("status") == "dead", "stale": (F.col("status") == "in_progress") & (now - F.col("locked_at") > lease)}
    return reduce(DataFrame.unionByName, [outbox.where(c).select(F.lit(v).alias("view"), "job_id") for v, c in views.items()])


def valid_lease(seconds: Column) -> Column:
    """A lease has a finite, positive length; otherwise two workers could own a job at once."""
    return F.coalesce(~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf")), F.lit(False))


def dependency_state(jobs: DataFrame) -> DataFrame:
    """jobs: event_id, projection_type, status. Of each job that depends on another of its event: ready, held, or blocked by a dead one."""
    needs = F.create_map(*[F.lit(x) for kv in DEPENDS.items() for x in kv])
    parents = jobs.groupBy("event_id", F.col("projection_type").alias("parent")).agg(F.bool_or(F.col("status") == "completed").alias("done"), F.bool_and(F.col("status") == "dead").alias("dead"))
    child = jobs.withColumn("parent", needs[F.col("projection_type")]).where("parent is not null").join(parents, ["event_id", "parent"], "left")
    return child.select("event_id", "projection_type", F.when(F.col("done"), "ready").when(F.col("dead"), "blocked").otherwise("held").alias("gate"))


def canonical(rows: DataFrame, fields: list[str]) -> DataFrame:
    """event_id and the hash of an observation's fields in the given order; nulls count as empty."""
    return rows.select("event_id", content_hash(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("hash"))


def determinism(rebuilds: list[DataFrame]) -> DataFrame:
    """rebuilds: event_id, hash each. event_id, hashes (different ones), builds."""
    return reduce(DataFrame.unionByName, rebuilds).groupBy("event_id").agg(F.count_distinct("hash").alias("hashes"), F.count("*").alias("builds"), F.min("hash").alias("hash"))


def execution_report(framed: DataFrame) -> DataFrame:
    """How often questions took the operator they asked for: counts with their denominator."""
    first = F.coalesce(F.try_element_at("tried", F.lit(1)), F.lit("recall"))
    back = F.col("operator") != first
    g = framed.agg(F.count("*").alias("questions"), F.count_if(F.size("tried") > 0).alias("structured"), F.count_if(F.col("operator") != "recall").alias("structured_taken"), F.count_if(back).alias("fallbacks"))
    return g.withColumn("fallback_rate", F.round(F.col("fallbacks") / F.greatest(F.col("structured"), F.lit(1)), 4))


def compared(base: DataFrame, new: DataFrame, least: float = 0.02) -> DataFrame:
    """base and new: family, score. Per family the change, and whether it counts."""
    j = base.select("family", F.col("score").alias("before")).join(new.select("family", F.col("score").alias("after")), "family", "full_outer")
    d = F.col("after") - F.col("before")
    return j.select("family", "before", "after", F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(d < -least, "regressed").when(d > least, "improved").otherwise("same").alias("verdict"))


def content_digest(rows: DataFrame) -> DataFrame:
    """n and digest of a table, whatever the order of its rows: sums of two hashes of every row."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    return rows.agg(F.count("*").alias("n"), F.md5(F.concat_ws("|", F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string")).cast("binary")).alias("digest"))


def fault_of(event_id: Column) -> Column:
    """The fault that a benchmark injects for an event, by the first 32 bits of its sha256."""
    at = F.conv(F.left(F.sha2(event_id.cast("string").cast("binary"), 256), F.lit(8)), 16, 10).cast("double") / float(0xFFFFFFFF)
    out, total = None, 0.0
    for name, weight in FAULTS:
        total += weight
        out = F.when(at < total, name) if out is None else out.when(at < total, name)
    return out.otherwise(FAULTS[-1][0])


def overhead(with_: DataFrame, without: DataFrame, by: str, value: str, q: float = 0.95) -> DataFrame:
    """Quantile of a latency with and without something, and their ratio."""
    p = lambda rows, name: rows.groupBy(by).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(name))
    return p(with_, "loaded").join(p(without, "plain"), by).withColumn("ratio", F.round(F.col("loaded") / F.col("plain"), 6))


def retried(outbox: DataFrame) -> DataFrame:
    """Jobs with the state that their attempts allow."""
    return outbox.withColumn("status", F.when((F.col("attempts") >= L.MAX_ATTEMPTS) & (F.col("status") == "pending"), "dead").otherwise(F.col("status")))


def newest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def processed(jobs: DataFrame, ledger: DataFrame, tombstones: DataFrame, now: float) -> DataFrame:
    """jobs: job_id, event_id, projection_type, status, projection_key. What a worker does with each job that is open: outcome, and for built
    ones the ledger row (projection_key) that is written with the projection in one append. A key that the ledger has is completed
    without another effect; a buried event is skipped; a job waits for, or dies with, the one it depends on."""
    open_ = jobs.where(F.col("status").isin("pending", "in_progress"))
    have = ledger.select("projection_key", F.lit(True).alias("have")).distinct()
    dead = tombstones.select("event_id", F.lit(True).alias("buried")).distinct()
    gate = dependency_state(jobs).select("event_id", "projection_type", "gate").distinct()
    j = open_.join(have, "projection_key", "left").join(dead, "event_id", "left").join(gate, ["event_id", "projection_type"], "left")
    outcome = F.when(F.col("have"), "completed_already").when(F.col("buried"), "skipped_tombstoned").when(F.col("gate") == "held", "held").when(F.col("gate") == "blocked", "dead_lettered").otherwise("built")
    first = F.row_number().over(Window.partitionBy("projection_key").orderBy("job_id")) == 1  # jobs that share a key build once
    out = j.withColumn("outcome", outcome).withColumn("first", first)
    return out.select("job_id", "projection_key", F.when((F.col("outcome") == "built") & ~F.col("first"), "completed_already").otherwise(F.col("outcome")).alias("outcome"), F.lit(now).alias("at"))


def decoded(rows: DataFrame, column: str, schema: str, default: str = "{}") -> DataFrame:
    """A JSON column as a struct; texts that are null or no JSON count as the default."""
    text = F.when(F.try_parse_json(column).isNotNull(), F.col(column)).otherwise(default)
    return rows.withColumn(column, F.from_json(text, schema))
