"""What a memory scores in a recall besides its terms and its vector: by the query's kind and the agent's state, and by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators.governance import security_rank
from tidemark.operators.matching import dealt

KINDS = (*(name for name, _ in L.QUERY_TYPES), "factual")  #: order of by_kind


def exception_active(now: Column) -> Column:
    """Whether an exception overrides its rule: it names one, is approved, isn't simulated, and its approval hasn't run out."""
    return F.col("governed_exception_for").isNotNull() & F.col("approved_by").isNotNull() & (F.col("epistemic_status") != "simulated") & (F.col("approval_expires_at").isNull() | (now < F.col("approval_expires_at")))


def states_time(c: Column) -> Column:
    """Whether a text says when: a date, a clock time, a weekday, a month with a day, a year, or a relative day."""
    return c.rlike(L.STATED_TIME)


def temporal(as_of: Column | None) -> Column:
    """For questions of time: a window that covers as_of, else any window, else a time stated in the text."""
    covers = F.lit(False) if as_of is None else (F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (as_of < F.col("valid_to")))
    return F.when(covers, 0.65).when(F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull(), 0.25).when(states_time(F.col("content")), 0.55).otherwise(0.0)


def state_match(state: dict[str, str]) -> Column:
    """Tags of the memory that agree with the agent's state, and rules where the risk is high. tags: map."""
    out = F.lit(0.0)
    for key in L.STATE_KEYS:
        if state.get(key) is not None:
            out = out + F.when(F.col("tags")[key] == state[key], 2.25).otherwise(0.0)
    return out + F.when(F.col("memory_type").isin("policy", "exception"), 0.45).otherwise(0.0) if state.get("risk_level") in L.HIGH_RISK else out


def context_match(state: dict[str, str]) -> Column:
    """Conditions under which the memory applies: 0.35 for each that the state meets, -0.5 for each it contradicts. context: map."""
    out = F.lit(0.0)
    for key, value in state.items():
        wanted = F.col("context")[key]
        out = out + F.when(wanted == value, 0.35).when(wanted.isNotNull(), -0.5).otherwise(0.0)
    return out


def by_kind(as_of: Column | None, state: dict[str, str]) -> Column:
    """What speaks of the query, for each kind of query in KINDS order."""
    here = state_match(state) + context_match(state)
    return F.array(*[S.lookup(F.col("memory_type"), L.TYPE_SCORES[k]) + here + (temporal(as_of) if k == "temporal" else F.lit(0.0)) for k in KINDS])


def strength(now: Column, state: dict[str, str]) -> Column:
    """How good a memory is, whatever is asked. label_junk and label_importance may be null."""
    out = 0.55 * F.col("confidence") + 0.45 * F.col("trust_tier") / 5 + 0.25 * F.col("utility") + 0.20 * F.col("salience")
    out = out + F.least(0.04 * F.col("reinforcement"), F.lit(0.25)) - F.least(0.15 * F.col("contradiction"), F.lit(0.75))
    out = out + F.when(F.col("lifecycle_state").isin("stable", "reinforced"), 0.20).when(F.col("lifecycle_state").isin("challenged", "deprecated", "archived"), -0.80).otherwise(0.0)
    out = out + F.when(F.col("memory_type") == "exception", F.when(exception_active(now), 0.45).otherwise(-1.50)).otherwise(0.0)
    out = out + S.lookup(F.col("epistemic_status"), L.EPISTEMIC_SCORES) + S.lookup(F.col("verification_status"), L.VERIFICATION_SCORES)
    if state.get("risk_level") in L.HIGH_RISK:
        out = out + F.when(F.col("epistemic_status") == "simulated", -1.25).otherwise(0.0) + F.when(F.col("verification_status") == "unverified", -0.55).otherwise(0.0)
    return out - F.when(F.col("label_junk"), L.LABEL_JUNK_PENALTY).otherwise(0.0) + F.coalesce((F.col("label_importance") - 5.0) * L.LABEL_IMPORTANCE_WEIGHT, F.lit(0.0))


def candidates(memories: DataFrame, now: Column, as_of: Column | None, state: dict[str, str]) -> DataFrame:
    """Memories as matching.hybrid wants them. Columns: those of the memory, tags and context (maps), embedding, labels."""
    return dealt(memories).select(
        F.col("memory_id").cast("long").alias("memory_id"), F.col("content").alias("text"), "tenant", "workspace", security_rank(F.col("security_label")).alias("security"),
        F.coalesce(F.col("trust_tier").cast("int"), F.lit(0)).alias("trust_tier"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        F.round(F.coalesce(strength(now, state), F.lit(0.0)), 9).alias("strength"), by_kind(as_of, state).alias("by_kind"), "embedding")


def questions(queries: DataFrame) -> DataFrame:
    """queries: item_id, text, tenant, workspace, most (label), embedding; as matching.hybrid wants them."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    return queries.select("item_id", "text", "tenant", "workspace", security_rank(F.col("most")).alias("clearance"), place[T.query_type(F.col("text"))].alias("kind"), "embedding")
