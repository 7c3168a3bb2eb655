"""Access, promotion, immune and prospective predicates; each returns its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

SECURITY_ORDER = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}
AUTHORITATIVE = ("identity", "policy", "exception", "self_model")
AUTHORITY_LANGUAGE = r"(system administrator|i am (the )?(admin|root|owner)|override (all )?polic|grant .{0,20}access)"
TENANT_LANGUAGE = r"(other tenant|all tenants|cross[- ]tenant|another workspace)"


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def security_rank(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SECURITY_ORDER.items() for x in kv])[c]


def access(memories: DataFrame, tenant: str, workspace: str | None, most: str) -> DataFrame:
    """Adds denied, the reasons why the context may not read a memory. A null workspace is shared."""
    return memories.withColumn("denied", reasons(
        (F.col("tenant") != tenant, "tenant_mismatch"),
        (F.col("workspace").isNotNull() & (F.lit(workspace).isNotNull()) & (F.col("workspace") != F.lit(workspace)), "workspace_mismatch"),
        (security_rank(F.col("security_label")) > SECURITY_ORDER[most], "security_label_exceeds_context")))


def promotion(memories: DataFrame) -> DataFrame:
    """Adds blocked, the reasons why a memory may not be promoted. Columns: approved_by, has_source beside the memory's."""
    top = F.col("memory_type").isin(*AUTHORITATIVE)
    return memories.withColumn("blocked", reasons(
        (top & (F.col("trust_tier") < 4), "authoritative_memory_requires_human_approval"),
        (top & F.col("approved_by").isNull(), "missing_approver"),
        (top & (F.col("epistemic_status") == "simulated"), "simulated_memory_cannot_be_authoritative"),
        (~F.col("has_source"), "missing_provenance"),
        ((F.col("lifecycle_state") == "stable") & (F.col("confidence") < 0.75), "stable_memory_confidence_too_low"),
        ((F.col("lifecycle_state") == "stable") & (F.col("verification_status") == "rejected"), "rejected_memory_cannot_be_stable")))


def immune(memories: DataFrame, source: Column) -> DataFrame:
    """Adds risk and quarantined: a sum of weighted findings, 1 at most; persistent writes from 0.6 on are set apart."""
    low = F.lower("content")
    scan = T.injected(F.col("content")) | (T.redacted(F.col("content")) != F.col("content"))
    simulated = (F.col("epistemic_status") == "simulated") & F.col("memory_type").isin("policy", "identity", "belief")
    weak = (F.col("trust_tier") <= 1) & F.col("memory_type").isin("policy", "identity", "procedural")
    parts = [(scan, 0.55), (low.rlike(AUTHORITY_LANGUAGE), 0.35), (low.rlike(TENANT_LANGUAGE), 0.45), (simulated, 0.60), (weak, 0.35), (source.startswith("web:") | source.startswith("email:"), 0.10)]
    risk = F.lit(0.0)
    for c, w in parts:
        risk = risk + F.when(c, w).otherwise(0.0)
    risk = F.round(F.least(risk, F.lit(1.0)), 6)
    return memories.withColumn("risk", risk).withColumn("quarantined", scan | (F.col("risk") >= 0.60))


def triggers(conditions: DataFrame, state: DataFrame) -> DataFrame:
    """conditions: trigger_id, priority, key, op, wanted. state: scope, key, actual. The (scope, trigger) whose conditions all hold."""
    met = F.when(F.col("op") == "eq", F.col("actual") == F.col("wanted")).when(F.col("op") == "gte", F.col("actual") >= F.col("wanted")).when(F.col("op") == "lte", F.col("actual") <= F.col("wanted")).otherwise(False)
    need = conditions.groupBy("trigger_id").agg(F.count("*").alias("need"))
    hit = state.join(conditions, "key").where(met).groupBy("scope", "trigger_id", "priority").agg(F.count("*").alias("got"))
    return hit.join(need, "trigger_id").where("got = need").select("scope", "trigger_id", "priority")
