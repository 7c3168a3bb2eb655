"""Audits of the event log, outbox and ledger: semi- and anti-joins, findings, replay and shadow comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions.text import content_hash


def finding(rows: DataFrame, code: str, severity: str, key: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("key"))


def outbox_without_event(outbox: DataFrame, events: DataFrame) -> DataFrame:
    return outbox.join(events.select("event_id"), "event_id", "left_anti")


def completed_without_projection(outbox: DataFrame, ledger: DataFrame) -> DataFrame:
    return outbox.where("status = 'completed'").join(ledger.select("event_id", "projection_type"), ["event_id", "projection_type"], "left_anti")


def skipped_with_ledger(outbox: DataFrame, ledger: DataFrame) -> DataFrame:
    return outbox.where("status = 'skipped'").join(ledger.select("event_id", "projection_type"), ["event_id", "projection_type"], "left_semi")


def projected_without_debt(events: DataFrame, outbox: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events that have a projection although no job ever owed one."""
    return events.join(ledger.select("event_id"), "event_id", "left_semi").join(outbox.select("event_id"), "event_id", "left_anti")


def ledger_tenant_mismatch(outbox: DataFrame, ledger: DataFrame) -> DataFrame:
    o, l = outbox.select("event_id", "projection_type", F.col("tenant").alias("own")), ledger
    return l.join(o, ["event_id", "projection_type"]).where(F.col("tenant") != F.col("own"))


def job_faults(outbox: DataFrame, now: float, lease: float = 3600.0) -> DataFrame:
    """Jobs in states that can't be: no owner, stale lease, too many attempts, dead without a reason, a key that isn't its hash."""
    owed = content_hash(F.col("event_id").cast("string"), F.col("projection_type"))
    rules = [
        ("in_progress_without_owner", "error", (F.col("status") == "in_progress") & F.col("locked_by").isNull()),
        ("stale_lease", "warning", (F.col("status") == "in_progress") & (now - F.col("locked_at") > lease)),
        ("attempts_exhausted", "error", (F.col("attempts") > L.MAX_ATTEMPTS) & (F.col("status") != "dead")),
        ("dead_without_reason", "warning", (F.col("status") == "dead") & F.col("last_error").isNull()),
        ("key_mismatch", "error", F.col("projection_key") != owed),
        ("bad_version", "error", F.col("projection_version") < 1),
    ]
    return reduce(DataFrame.unionByName, [finding(outbox.where(c), code, sev, "job_id") for code, sev, c in rules])


def doctor(events: DataFrame, outbox: DataFrame, ledger: DataFrame, now: float) -> DataFrame:
    """All findings: code, severity, key."""
    doubles = outbox.groupBy("event_id", "projection_type").count().where("count > 1")
    checks = [
        finding(outbox_without_event(outbox, events), "outbox_without_event", "error", "job_id"),
        finding(completed_without_projection(outbox, ledger), "completed_without_projection", "error", "job_id"),
        finding(skipped_with_ledger(outbox, ledger), "skipped_with_ledger", "warning", "job_id"),
        finding(ledger_tenant_mismatch(outbox, ledger), "ledger_tenant_mismatch", "critical", "target_id"),
        finding(projected_without_debt(events, outbox, ledger), "projected_without_debt", "warning", "event_id"),
        finding(doubles, "duplicate_jobs", "error", "event_id"), job_faults(outbox, now),
    ]
    return reduce(DataFrame.unionByName, checks)


SEVERITY = {"info": 0, "warning": 1, "error": 2, "critical": 3}
#: which findings a plan may repair, and how
RECIPES = {"completed_without_projection": "reset_to_pending", "stale_lease": "release_lease", "attempts_exhausted": "mark_dead", "in_progress_without_owner": "release_lease", "key_mismatch": "recompute_key", "skipped_with_ledger": "mark_completed"}


def repair_plan(findings: DataFrame) -> DataFrame:
    """Findings with their recipe; those without one need a person."""
    recipe = F.create_map(*[F.lit(x) for kv in RECIPES.items() for x in kv])
    return findings.withColumn("repair", F.coalesce(recipe[F.col("code")], F.lit("manual")))


def replay_scan(events: DataFrame, outbox: DataFrame, versions: dict[str, int], now: float, stale: float = 3600.0) -> DataFrame:
    """What each event owes for each projection type: missing, pending, stale, dead, version_drift or done.

    Types are the few that the caller names; each event is exploded by them, which needs no join.
    """
    types = F.explode(F.array(*[F.struct(F.lit(k).alias("projection_type"), F.lit(v).alias("wanted")) for k, v in versions.items()]))
    owed = events.select("event_id", types.alias("t")).select("event_id", "t.*")
    last = outbox.groupBy("event_id", "projection_type").agg(F.max_by(F.struct("status", "locked_at", "projection_version"), "projection_version").alias("j"))
    j = owed.join(last, ["event_id", "projection_type"], "left")
    state = (F.when(F.col("j").isNull(), "missing").when(F.col("j.status") == "pending", "pending").when((F.col("j.status") == "in_progress") & (now - F.col("j.locked_at") > stale), "stale")
             .when(F.col("j.status") == "dead", "dead").when(F.col("j.projection_version") != F.col("wanted"), "version_drift").otherwise("done"))
    return j.select("event_id", "projection_type", state.alias("state"))


def shadow_compare(legacy: DataFrame, shadow: DataFrame, fields: list[str]) -> DataFrame:
    """Full outer comparison by event_id: match, missing side, or the first field that differs, in the given order."""
    a = legacy.select("event_id", F.struct(*fields).alias("l"))
    b = shadow.select("event_id", F.struct(*fields).alias("s"))
    j = a.join(b, "event_id", "full_outer")
    out = F.when(F.col("l").isNull(), "missing_legacy").when(F.col("s").isNull(), "missing_shadow")
    for f in fields:
        out = out.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"s.{f}")), f"mismatch_{f}")
    return j.select("event_id", out.otherwise("match").alias("verdict"))


def without_tombstoned(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """tombstones: key, placed (boolean), seq. The last entry of a key decides."""
    dead = tombstones.groupBy(key).agg(F.max_by("placed", "seq").alias("placed")).where("placed").select(key)
    return rows.join(dead, key, "left_anti")


def insert_if_absent(jobs: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.dropDuplicates(keys).join(jobs.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def since(rows: DataFrame, cursor: int, key: str = "event_id") -> DataFrame:
    """Rows beyond an incremental cursor; the filter reaches the scan."""
    return rows.where(F.col(key) > cursor)
