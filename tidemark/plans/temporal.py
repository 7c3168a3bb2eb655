"""Queries of the temporal family over claims derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import claims as C
from tidemark.operators.quantiles import nearest_rank_time
from tidemark.plans.registry import query
from tidemark.sources.adapters import CLAIMS_SQL, claims, table

SPANS_SQL = CLAIMS_SQL + """,
opened AS (SELECT *, row_number() OVER k = 1 OR kind NOT IN ('assert', 'repeat') AS opens FROM claims WINDOW k AS (PARTITION BY subject, predicate, bucket ORDER BY observed_at, event_id)),
islands AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY subject, predicate, bucket ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM opened),
counted AS (SELECT *, count(*) OVER (PARTITION BY subject, predicate, bucket, island) - 1 AS confirmations, kind = 'conflict' AS disputed FROM islands),
kept AS (SELECT * FROM counted WHERE opens),
based AS (SELECT *, CASE WHEN kind <> 'correct' OR row_number() OVER l = 1 THEN observed_at END AS base, coalesce(lead(kind) OVER l = 'correct', false) AND NOT disputed AS retracted
  FROM kept WINDOW l AS (PARTITION BY subject, predicate, disputed ORDER BY observed_at, event_id)),
dated AS (SELECT *, CASE WHEN disputed THEN observed_at ELSE last_value(base IGNORE NULLS) OVER (PARTITION BY subject, predicate, disputed ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) END AS valid_from FROM based),
closed AS (SELECT *, CASE WHEN retracted THEN valid_from WHEN NOT disputed THEN lead(valid_from) OVER (PARTITION BY subject, predicate, NOT disputed AND NOT retracted ORDER BY observed_at, event_id) END AS valid_to FROM dated),
spans AS (SELECT *, CASE WHEN disputed THEN 'disputed' WHEN retracted THEN 'corrected' WHEN valid_to IS NOT NULL THEN 'superseded' ELSE 'open' END AS status FROM closed)"""



def _at(spark: SparkSession, sf_dir: str):
    """The middle of the event log's time, as a scalar subquery."""
    return nearest_rank_time(claims(spark, sf_dir), "observed_at", 0.5)


MID_SQL = "(SELECT quantile_disc(observed_at, 0.5) FROM claims)"


@query("claim_history", f"WITH {SPANS_SQL} SELECT event_id, subject, predicate, bucket, kind, observed_at, confirmations, disputed, retracted, valid_from, valid_to, status FROM spans")
def claim_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spans(claims(spark, sf_dir)).select("event_id", "subject", "predicate", "bucket", "kind", "observed_at", "confirmations", "disputed", "retracted", "valid_from", "valid_to", "status")


@query("state_at_now", f"""WITH {SPANS_SQL}, s AS (SELECT subject, predicate, count(*) FILTER (NOT disputed AND NOT retracted AND valid_to IS NULL) AS holding, count(*) FILTER (disputed) AS competing,
  max(struct_pack(o := observed_at, e := event_id, b := bucket)) FILTER (NOT disputed AND NOT retracted AND valid_to IS NULL) AS top FROM spans GROUP BY ALL)
SELECT subject, predicate, CASE WHEN holding > 1 THEN 'CONFLICT' WHEN holding = 1 THEN 'KNOWN' WHEN competing > 0 THEN 'CONFLICT' ELSE 'UNKNOWN' END AS state, CASE WHEN holding = 1 THEN top.b END AS value, holding, competing FROM s""")
def state_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.state_at(C.spans(claims(spark, sf_dir)), None)


@query("state_at", f"""WITH {SPANS_SQL}, m AS (SELECT {MID_SQL} AS t), j AS (SELECT *, NOT disputed AND NOT retracted AND valid_from <= t AND (valid_to IS NULL OR t < valid_to) AS h, disputed AND observed_at <= t AS c FROM spans, m),
s AS (SELECT subject, predicate, count(*) FILTER (h) AS holding, count(*) FILTER (c) AS competing, max(struct_pack(o := observed_at, e := event_id, b := bucket)) FILTER (h) AS top FROM j GROUP BY ALL)
SELECT subject, predicate, CASE WHEN holding > 1 THEN 'CONFLICT' WHEN holding = 1 THEN 'KNOWN' WHEN competing > 0 THEN 'CONFLICT' ELSE 'UNKNOWN' END AS state, CASE WHEN holding = 1 THEN top.b END AS value, holding, competing FROM s""")
def state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.state_at(C.spans(claims(spark, sf_dir)), _at(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each event: what held in its slot an hour before it?"""
    return claims(spark, sf_dir).select(F.col("event_id").alias("question_id"), "subject", "predicate", (F.col("observed_at") - F.expr("INTERVAL 1 HOUR")).alias("asked_at"))


_Q = "q AS (SELECT event_id AS question_id, subject, predicate, observed_at - INTERVAL 1 HOUR AS asked_at FROM claims)"


@query("asof_world", f"""WITH {SPANS_SQL}, {_Q}, j AS (SELECT q.*, s.event_id, s.bucket, NOT retracted AND valid_from <= asked_at AS ok, (valid_to IS NULL OR asked_at < valid_to) AS h, observed_at FROM q LEFT JOIN spans s USING (subject, predicate))
SELECT question_id, subject, predicate, asked_at, arg_max(event_id, struct_pack(h := h, o := observed_at, e := event_id)) FILTER (ok) AS event_id, arg_max(bucket, struct_pack(h := h, o := observed_at, e := event_id)) FILTER (ok) AS bucket FROM j GROUP BY ALL""")
def asof_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.as_of(C.spans(claims(spark, sf_dir)), _questions(spark, sf_dir))


@query("asof_belief", f"""WITH {SPANS_SQL}, {_Q}, j AS (SELECT q.*, s.event_id, s.bucket, observed_at <= asked_at AS ok, observed_at FROM q LEFT JOIN spans s USING (subject, predicate))
SELECT question_id, subject, predicate, asked_at, arg_max(event_id, struct_pack(o := observed_at, e := event_id)) FILTER (ok) AS event_id, arg_max(bucket, struct_pack(o := observed_at, e := event_id)) FILTER (ok) AS bucket FROM j GROUP BY ALL""")
def asof_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.as_of(C.spans(claims(spark, sf_dir)), _questions(spark, sf_dir), belief=True)


@query("before_after_anchor", f"""WITH {SPANS_SQL}, u AS (SELECT *, lag(bucket) OVER w AS before, lead(bucket) OVER w AS after FROM spans WHERE NOT retracted WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, event_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY observed_at, event_id) AS n FROM u WHERE bucket = 1) SELECT subject, predicate, event_id, before, after FROM f WHERE n = 1""")
def before_after_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.around_anchor(C.spans(claims(spark, sf_dir)), 1)


@query("history_usable", f"WITH {SPANS_SQL} SELECT subject, predicate, count(*) AS n_spans, min(observed_at) AS first_at, max(observed_at) AS last_at, arg_max(bucket, struct_pack(o := observed_at, e := event_id)) AS latest, arg_min(bucket, struct_pack(o := observed_at, e := event_id)) AS earliest FROM spans WHERE NOT retracted GROUP BY ALL")
def history_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("observed_at", "event_id")
    return C.spans(claims(spark, sf_dir)).where(~F.col("retracted")).groupBy("subject", "predicate").agg(F.count("*").alias("n_spans"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.max_by("bucket", key).alias("latest"), F.min_by("bucket", key).alias("earliest"))


@query("ever_held", f"WITH {SPANS_SQL} SELECT subject, predicate, CASE WHEN bool_or(bucket = 2 AND NOT disputed AND NOT retracted) THEN 'yes' ELSE 'no' END AS verdict, count(*) FILTER (bucket = 2) AS mentions FROM spans GROUP BY ALL")
def ever_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ever(C.spans(claims(spark, sf_dir)), 2)


@query("conflict_state", f"""WITH {SPANS_SQL}, m AS (SELECT {MID_SQL} AS t) SELECT subject, predicate, count(*) AS claims, count(DISTINCT bucket) AS propositions FROM spans, m
WHERE NOT retracted AND valid_from <= t AND (valid_to IS NULL OR t < valid_to) AND predicate <> 'view' GROUP BY ALL HAVING count(DISTINCT bucket) > 1""")
def conflict_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-valued slots of which several different claims survive a point-in-time selection, rumours included."""
    h = C.spans(claims(spark, sf_dir)).where(~F.col("retracted")).where(C.holds_at(_at(spark, sf_dir))).where("predicate <> 'view'")
    return h.groupBy("subject", "predicate").agg(F.count("*").alias("claims"), F.count_distinct("bucket").alias("propositions")).where("propositions > 1")


@query("interval_audit", f"WITH {SPANS_SQL} SELECT count(*) AS ends_at_dispute FROM spans s JOIN (SELECT DISTINCT subject, predicate, valid_from AS f FROM spans WHERE disputed) d ON s.subject = d.subject AND s.predicate = d.predicate AND s.valid_to = d.f WHERE NOT s.retracted AND NOT s.disputed")
def interval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.spans(claims(spark, sf_dir))
    d = h.where("disputed").select("subject", "predicate", F.col("valid_from").alias("valid_to")).distinct()
    return h.where("not retracted and not disputed").join(d, ["subject", "predicate", "valid_to"], "left_semi").agg(F.count("*").alias("ends_at_dispute"))


_LIKE = "CASE predicate WHEN 'click' THEN 'fast' WHEN 'purchase' THEN 'medium' WHEN 'error' THEN 'volatile' WHEN 'signup' THEN 'immutable' ELSE 'slow' END"


@query("relation_adjacent", f"""WITH {CLAIMS_SQL}, p AS (SELECT *, lag(bucket) OVER w AS held, lag(observed_at) OVER w AS held_at, {_LIKE} AS vol FROM claims WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, event_id)),
r AS (SELECT *, CASE WHEN held = bucket THEN 'same_value' WHEN kind = 'correct' THEN 'explicit_correction' WHEN kind = 'conflict' THEN 'alternative_source' WHEN predicate = 'signup' THEN 'immutable_disagreement'
  WHEN predicate = 'view' THEN 'coexistence_allowed' WHEN observed_at <= held_at THEN 'not_later' WHEN kind = 'supersede' THEN 'revisable_single_valued' ELSE 'unmarked_value_change' END AS rule FROM p WHERE held IS NOT NULL)
SELECT event_id, subject, predicate, CASE rule WHEN 'same_value' THEN 'REPEAT' WHEN 'explicit_correction' THEN 'CORRECT' WHEN 'coexistence_allowed' THEN 'COEXIST' WHEN 'revisable_single_valued' THEN 'SUPERSEDE' WHEN 'unmarked_value_change' THEN 'UNKNOWN' ELSE 'CONFLICT' END AS relation, rule,
  round(CASE rule WHEN 'same_value' THEN 0.95 WHEN 'explicit_correction' THEN 0.9 WHEN 'alternative_source' THEN 0.85 WHEN 'immutable_disagreement' THEN 0.8 WHEN 'coexistence_allowed' THEN 0.85 WHEN 'not_later' THEN 0.75
    WHEN 'revisable_single_valued' THEN 0.6 + CASE vol WHEN 'volatile' THEN 0.15 WHEN 'fast' THEN 0.1 WHEN 'medium' THEN 0.05 ELSE 0 END ELSE 0 END::DOUBLE, 3) AS confidence FROM r""")
def relation_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.adjacent_relations(claims(spark, sf_dir))


@query("relation_held", f"""WITH RECURSIVE {CLAIMS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY observed_at, event_id) AS i FROM claims),
f AS (SELECT event_id, subject, predicate, i, 'FIRST' AS relation, bucket AS held FROM n WHERE i = 1
  UNION ALL SELECT n.event_id, n.subject, n.predicate, n.i,
    CASE WHEN n.bucket = f.held THEN 'REPEAT' WHEN n.kind = 'correct' THEN 'CORRECT' WHEN n.kind = 'conflict' OR n.predicate = 'signup' THEN 'CONFLICT' WHEN n.predicate = 'view' THEN 'COEXIST' WHEN n.kind = 'supersede' THEN 'SUPERSEDE' ELSE 'UNKNOWN' END,
    CASE WHEN n.bucket = f.held THEN f.held WHEN n.kind = 'correct' THEN n.bucket WHEN n.kind = 'conflict' OR n.predicate IN ('signup', 'view') THEN f.held WHEN n.kind = 'supersede' THEN n.bucket ELSE f.held END
  FROM f JOIN n ON n.subject = f.subject AND n.predicate = f.predicate AND n.i = f.i + 1)
SELECT event_id, subject, predicate, relation, held FROM f""")
def relation_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.held_relations(claims(spark, sf_dir))


@query("lifecycle_current_state", f"""WITH {CLAIMS_SQL}, t AS (SELECT subject || ':' || predicate AS claim, CASE kind WHEN 'repeat' THEN 'RECONFIRMED' WHEN 'correct' THEN 'CORRECTED' WHEN 'conflict' THEN 'DISPUTED' WHEN 'supersede' THEN 'SUPERSEDED' ELSE 'ASSERTED' END AS s, observed_at, event_id FROM claims)
SELECT claim, arg_max(s, struct_pack(o := observed_at, e := event_id)) AS state, count(*) AS transitions FROM t WHERE s <> 'RECONFIRMED' GROUP BY claim""")
def lifecycle_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    to = F.when(F.col("kind") == "repeat", "RECONFIRMED").when(F.col("kind") == "correct", "CORRECTED").when(F.col("kind") == "conflict", "DISPUTED").when(F.col("kind") == "supersede", "SUPERSEDED").otherwise("ASSERTED")
    return C.current_state(c.select(F.concat_ws(":", F.col("subject").cast("string"), "predicate").alias("claim"), to.alias("to_state"), F.struct("observed_at", "event_id").alias("seq")))


@query("world_snapshot", f"""WITH {CLAIMS_SQL}, m AS (SELECT {MID_SQL} AS t), r AS (SELECT subject AS entity, predicate AS attribute, bucket AS value, observed_at AS valid_from, k / 100.0::DOUBLE AS confidence, event_id AS seq,
  row_number() OVER (PARTITION BY subject, predicate ORDER BY date_trunc('day', observed_at) DESC, k DESC, event_id) AS n FROM claims, m WHERE kind <> 'conflict' AND date_trunc('day', observed_at) <= t)
SELECT entity, attribute, value, date_trunc('day', valid_from) AS valid_from, confidence, seq FROM r WHERE n = 1""")
def world_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = claims(spark, sf_dir).where("kind <> 'conflict'").select(F.col("subject").alias("entity"), F.col("predicate").alias("attribute"), F.col("bucket").alias("value"), F.date_trunc("day", "observed_at").cast("timestamp_ntz").alias("valid_from"), (F.col("k") / 100.0).alias("confidence"), F.col("event_id").alias("seq"))
    return C.world_snapshot(facts, _at(spark, sf_dir))


@query("truth_ledger", f"WITH {SPANS_SQL} SELECT subject, predicate, bucket, bool_or(status = 'open') AS is_current, bool_or(status IN ('open', 'superseded')) AS was_ever, bool_and(status = 'corrected') AS never_true, sum(confirmations)::BIGINT AS confirmations, max(observed_at) AS last_confirmed FROM spans GROUP BY ALL")
def truth_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return C.spans(claims(spark, sf_dir)).groupBy("subject", "predicate", "bucket").agg(F.bool_or(s == "open").alias("is_current"), F.bool_or(s.isin("open", "superseded")).alias("was_ever"), F.bool_and(s == "corrected").alias("never_true"), F.sum("confirmations").alias("confirmations"), F.max("observed_at").alias("last_confirmed"))


@query("slot_backfill", f"WITH {CLAIMS_SQL} SELECT predicate AS attribute, count(*) AS n_rows, count(*) FILTER (k % 4 = 0) AS stored, count(*) FILTER (k % 4 = 0 AND k % 8 = 4) AS disagree, round(count(*) FILTER (k % 4 = 0) / count(*)::DOUBLE, 6) AS coverage FROM claims GROUP BY 1")
def slot_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose slot is stored already, and how often the resolver would name another."""
    stored = F.when(F.col("k") % 4 == 0, F.when(F.col("k") % 8 == 4, "other").otherwise(F.col("predicate")))
    c = claims(spark, sf_dir).withColumn("stored", stored)
    return c.groupBy(F.col("predicate").alias("attribute")).agg(F.count("*").alias("n_rows"), F.count("stored").alias("stored"), F.count_if(F.col("stored") != F.col("predicate")).alias("disagree"), F.round(F.count("stored") / F.count("*"), 6).alias("coverage"))


@query("lifecycle_writes", f"WITH {SPANS_SQL} SELECT status, kind, count(*) AS n, count(valid_to) AS closed, sum(confirmations)::BIGINT AS confirmations FROM spans GROUP BY ALL")
def lifecycle_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spans(claims(spark, sf_dir)).groupBy("status", "kind").agg(F.count("*").alias("n"), F.count("valid_to").alias("closed"), F.sum("confirmations").alias("confirmations"))


@query("late_observations", f"""WITH {CLAIMS_SQL}, p AS (SELECT *, max(observed_at) OVER (PARTITION BY subject, predicate ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM claims)
SELECT predicate, count(*) FILTER (observed_at <= seen) AS late, count(*) FILTER (observed_at <= seen AND kind = 'correct') AS late_corrections, count(*) AS n FROM p GROUP BY 1""")
def late_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that arrive after a later one of their slot: they never close a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject", "predicate").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("observed_at") <= F.max("observed_at").over(w)
    c = claims(spark, sf_dir).withColumn("late", F.coalesce(late, F.lit(False)))
    return c.groupBy("predicate").agg(F.count_if("late").alias("late"), F.count_if(F.col("late") & (F.col("kind") == "correct")).alias("late_corrections"), F.count("*").alias("n"))


@query("claim_selection", """WITH m AS (SELECT event_id AS i, user_id, event_id % 6 AS t FROM events), q AS (SELECT DISTINCT 'Trần ' || chr(65 + (user_id % 26)::INTEGER) AS subject FROM events)
SELECT subject AS question_id, i AS memory_id, CASE WHEN t IN (0, 1) THEN 'structured' WHEN t = 2 THEN 'text' ELSE 'rescued' END AS by FROM m JOIN q ON q.subject = 'Trần ' || chr(65 + (m.user_id % 26)::INTEGER) WHERE t IN (0, 2) OR (t = 3 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.t = 0 AND x.user_id % 26 = m.user_id % 26))""")
def claim_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which memories a question about a salary reads: structured ones of the slot, older ones by their text, and, where there are
    none of the first kind, such as name the slot only in words."""
    t, who = F.col("event_id") % 6, F.concat(F.lit("Trần "), F.char(65 + F.col("user_id") % 26))
    text = F.when(t == 3, F.concat(F.lit("lương của "), who, F.lit(" là 5"))).when(t == 4, F.concat(who, F.lit(" sống ở Huế"))).when(t == 5, F.lit("lương là 5")).otherwise(F.concat(F.lit("về "), who))
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("memory_id"), F.when(t <= 1, who).alias("entity"), F.when(t == 1, "location").when(t.isin(0, 2), "salary").alias("slot"), text.alias("content"))
    q = table(spark, sf_dir, "events").select(who.alias("subject")).distinct().select(F.col("subject").alias("question_id"), "subject", F.lit("salary").alias("predicate"))
    return C.selected(m, q, rescue=True)


@query("stored_windows", f"""WITH {SPANS_SQL}, s AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2020-01-01' END AS sf, CASE WHEN event_id % 8 = 0 THEN TIMESTAMP '2020-01-01' WHEN event_id % 4 = 0 THEN TIMESTAMP '2030-01-01' END AS st FROM spans)
SELECT event_id, coalesce(sf, valid_from) AS valid_from, coalesce(st, valid_to) AS valid_to, CASE WHEN coalesce(coalesce(sf, valid_from) = coalesce(st, valid_to), false) THEN 'corrected' WHEN disputed THEN 'disputed' WHEN coalesce(st, valid_to) IS NOT NULL THEN 'superseded' ELSE 'open' END AS status FROM s""")
def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that were written down override those derived; empty ones mean corrected."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    i = F.col("event_id")
    stored = table(spark, sf_dir, "events").where(i % 4 == 0).select("event_id", at("2020-01-01").alias("stored_from"), F.when(i % 8 == 0, at("2020-01-01")).otherwise(at("2030-01-01")).alias("stored_to"))
    return C.with_stored(C.spans(claims(spark, sf_dir)), stored).select("event_id", "valid_from", "valid_to", "status")
