"""Queries of question planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.operators import planner as P
from tidemark.plans.registry import query
from tidemark.sources.adapters import table

q = lambda s: s.replace("'", "''")
#: questions: benchmark texts with an ending that names a predicate in some of them
ENDINGS = (" vai tro vi chuc việc nơi", " chức vụ gì", " sống ở đâu", " mức lương", " làm việc ở đâu dự án nào", " date of birth", " work", " hôm qua", " deploy")
_Q = "q AS (SELECT item_id, text || " + "CASE item_id % 9 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS)) + " END AS x FROM benchmark)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("item_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", ending).alias("x"))


def _any(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{q(p)}')" for p in phrases) + ")"


_has = lambda p: f"regexp_matches(lower(x), '{q(p)}')" if "." in p else f"contains(lower(x), '{q(p)}')"
_BEST = "CASE " + " ".join(f"WHEN {_has(p)} THEN '{n}'" for p, n in P._PHRASES) + " END"
_ONE = "CASE " + " ".join(f"WHEN contains(lower(x), '{q(w)}') THEN '{n}'" for w, n in P.DISCRIMINATING.items()) + " END"
_RIVALS = " + ".join("(" + (" OR ".join(_has(p) for p, n in P._PHRASES if n == pred) or "false") + ")::INTEGER" for pred in P.ONTOLOGY)
_list = lambda ws: "[" + ", ".join(f"'{q(w)}'" for w in ws) + "]"
_SHARED = " UNION ALL ".join(f"SELECT item_id, '{pred}' AS p, len(list_intersect(w, {_list(ws)})) AS n FROM ws" for pred, ws in P.VOCABULARY.items())


_ASPECT = f"""{_Q}, ws AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')), lambda w: length(w) > 1 AND NOT list_contains({_list(sorted(P.STOP))}, w)) AS w FROM q), sh AS ({_SHARED}),
o AS (SELECT item_id, arg_max(p, n) AS p FROM (SELECT *, max(n) OVER (PARTITION BY item_id) AS m FROM sh) WHERE n = m AND n >= 2 GROUP BY item_id HAVING count(*) = 1),
r AS (SELECT item_id, x, {_BEST} AS best, {_ONE} AS one, {_RIVALS} AS rivals FROM q),
aspect AS (SELECT item_id, x, coalesce(best, one, o.p, 'unknown') AS predicate, CASE WHEN rivals = 1 THEN 0.95 WHEN rivals > 1 THEN 0.75 WHEN one IS NOT NULL THEN 0.8 WHEN o.p IS NOT NULL THEN 0.6 ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN best IS NOT NULL THEN 'alias' WHEN one IS NOT NULL THEN 'discriminating' WHEN o.p IS NOT NULL THEN 'overlap' ELSE 'none' END AS method FROM r LEFT JOIN o USING (item_id))"""


@query("resolve_aspect", f"WITH {_ASPECT} SELECT item_id, predicate, confidence, method FROM aspect")
def resolve_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, m = P.predicate(F.col("x"))
    return _questions(spark, sf_dir).select("item_id", p.alias("predicate"), c.alias("confidence"), m.alias("method"))


def _first(t: tuple, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(ps)} THEN '{n}'" for n, ps in t) + f" ELSE '{default}' END"


@query("intent_router", f"WITH {_Q} SELECT item_id, {_first(P.ROUTER, 'casual')} AS intent, {_first(P.PREFETCH, 'operate')} AS prefetch FROM q")
def intent_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("item_id", P.intent(F.col("x")).alias("intent"), P.prefetch_intent(F.col("x")).alias("prefetch"))


@query("plan_route", f"WITH {_ASPECT} SELECT item_id, CASE WHEN regexp_matches(x, '{q(L.EVER)}', 'i') THEN 'ever' WHEN regexp_matches(x, '{q(L.TEMPORAL)}', 'i') THEN 'temporal' WHEN predicate <> 'unknown' THEN 'state' WHEN regexp_matches(x, '{q(L.SELF_HISTORY)}', 'i') THEN 'class' ELSE 'recall' END AS route FROM aspect")
def plan_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("item_id", P.route(F.col("x")).alias("route"))


#: people, and questions about them: text, anchor, date, kind of time, about beliefs, value, predicate, confidence, operator
PEOPLE = ("Trần Hà", "Bùi Cường", "Đỗ Văn Nam")
ASKED = (
    ("Hiện tại % làm việc ở đâu?", None, None, "current", False, "", "employer", 0.75, "state", "làm việc"),
    ("Vào ngày 12/03/2025 % sống ở đâu?", None, "2025-03-12", "point_in_time", False, "", "location", 0.95, "temporal", "sống"),
    ("Trước khi sang Bình Minh thì % làm ở đâu?", "Bình Minh", None, "before", False, "", "employer", 0.75, "temporal", "làm"),
    ("% đã từng giữ chức trưởng phòng chưa?", None, None, "point_in_time", False, "trưởng phòng", "role", 0.95, "ever", "giữ chức trưởng phòng chưa"),
    ("Lương của % là bao nhiêu?", None, None, "point_in_time", False, "bao nhiêu", "salary", 0.8, "state", "lương bao nhiêu"),
    ("hệ thống tin rằng tháng 5/2024 % phụ trách dự án nào", None, "2024-05-01", "point_in_time", True, "", "project", 0.95, "temporal", "hệ thống tin phụ trách dự án"),
    ("% đã đổi số điện thoại mấy lần?", None, None, "history", False, "", "phone", 0.95, "temporal", "đổi số điện thoại mấy lần"),
    ("sau khi rời Hòa Phát, % giữ chức gì", "Hòa Phát", None, "after", False, "", "role", 0.95, "temporal", "giữ chức"),
)


def _about_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    name = F.element_at(F.array(*[F.lit(p) for p in PEOPLE]), (u % len(PEOPLE) + 1).cast("int"))
    asked = F.element_at(F.array(*[F.lit(a[0]) for a in ASKED]), (u % len(ASKED) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.replace(asked, F.lit("%"), name).alias("text"))


_lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, float) else f"'{v}'"
_pick = lambda i: f"[{', '.join(_lit(a[i]) for a in ASKED)}][user_id % {len(ASKED)} + 1]"
_WHO = f"[{', '.join(_lit(p) for p in PEOPLE)}][user_id % {len(PEOPLE)} + 1]"
_U = "WITH u AS (SELECT DISTINCT user_id FROM events)"


@query("question_frame", f"{_U} SELECT user_id, {_pick(9)} AS leftover, {_WHO} AS subject, {_pick(1)} AS anchor, {_pick(2)} AS asked_date, {_pick(3)} AS temporal_kind, {_pick(4)} AS belief, {_pick(5)} AS value, {_pick(6)} AS predicate, {_pick(7)}::DOUBLE AS confidence, {_pick(8)} AS operator FROM u")
def question_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who, what, when and how a question asks, and the operator that answers it; the SQL states the expected parts literally."""
    rows = P.framed(_about_people(spark, sf_dir))
    return rows.select("user_id", *[F.col(f"frame.{c}").alias(c) for c in ("subject", "anchor", "asked_date", "temporal_kind", "belief", "value", "leftover")], "predicate", "confidence", "operator")


@query("proper_names", f"{_U} SELECT user_id, CASE WHEN {_pick(1)} IS NULL THEN {_WHO} ELSE {_pick(1)} || '|' || {_WHO} END AS names FROM u")
def proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _about_people(spark, sf_dir).select("user_id", F.array_join(P.names(F.col("text")), "|").alias("names"))


@query("frame_answers", f"""{_U}, a AS (SELECT user_id, {_pick(6)} AS predicate, {_pick(8)} AS operator, {_pick(2)}::DATE AS d FROM u WHERE {_pick(8)} IN ('state', 'temporal') AND {_pick(3)} IN ('current', 'point_in_time')),
c AS (SELECT user_id AS subject, CASE event_type WHEN 'click' THEN 'role' WHEN 'purchase' THEN 'employer' WHEN 'error' THEN 'salary' WHEN 'signup' THEN 'location' ELSE 'project' END AS predicate, ts, event_id, CAST(floor(value / 50) AS INTEGER) AS bucket FROM events)
SELECT a.user_id, a.predicate, a.operator, arg_max(bucket, struct_pack(t := ts, e := event_id)) FILTER (d IS NULL OR ts <= d + INTERVAL 1 YEAR) AS value FROM a LEFT JOIN c ON c.subject = a.user_id AND c.predicate = a.predicate GROUP BY ALL""")
def frame_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a question's text to its answer: the frame picks subject, predicate and time, which select in the claim history."""
    rows = P.framed(_about_people(spark, sf_dir)).where("operator in ('state', 'temporal') and frame.temporal_kind in ('current', 'point_in_time')")
    e = table(spark, sf_dir, "events")
    slot = F.when(F.col("event_type") == "click", "role").when(F.col("event_type") == "purchase", "employer").when(F.col("event_type") == "error", "salary").when(F.col("event_type") == "signup", "location").otherwise("project")
    c = e.select(F.col("user_id").alias("subject"), slot.alias("slot"), "ts", "event_id", F.floor(F.col("value") / 50).cast("int").alias("bucket"))
    by = F.col("asked_date").cast("timestamp_ntz") + F.expr("interval 1 year")
    asked = rows.select("user_id", "predicate", "operator", F.col("frame.asked_date").alias("asked_date"))
    met = asked.join(c, (F.col("subject") == F.col("user_id")) & (F.col("slot") == F.col("predicate")), "left")
    seen = F.col("asked_date").isNull() | (F.col("ts") <= by)
    return met.groupBy("user_id", "predicate", "operator").agg(F.max_by("bucket", F.when(seen, F.struct("ts", "event_id"))).alias("value"))


@query("existence_question", r"WITH s AS (SELECT user_id, 'has Người ' || user_id || ' ever worked at Công ty ' || (user_id % 5) || '?' AS x FROM events GROUP BY 1) SELECT user_id, regexp_extract(x, 'has (.+) ever', 1) AS subject, 'employer' AS predicate, regexp_extract(x, 'worked at ([^?]+)', 1) AS value FROM s")
def existence_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, value) of was-it-ever-true questions."""
    u = F.col("user_id").cast("string")
    s = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.concat(F.lit("has Người "), u, F.lit(" ever worked at Công ty "), (F.col("user_id") % 5).cast("string"), F.lit("?")).alias("x"))
    p, _, _ = P.predicate(F.col("x"))
    return s.select("user_id", F.regexp_extract("x", "has (.+) ever", 1).alias("subject"), p.alias("predicate"), F.regexp_extract("x", r"worked at ([^?]+)", 1).alias("value"))


@query("prefetch_plan", f"WITH {_Q}, i AS (SELECT item_id, x, {_first(P.PREFETCH, 'operate')} AS intent FROM q) SELECT item_id, intent, t AS types, md5(x || '. Relevant ' || t) AS query_md5 FROM (SELECT *, CASE intent " + " ".join(f"WHEN '{k}' THEN '{' '.join(v)}'" for k, v in P.PREFETCHED.items()) + " END AS t FROM i)")
def prefetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each action will need, and the query that fetches it."""
    i, t, text = P.prefetch(F.col("x"))
    return _questions(spark, sf_dir).select("item_id", i.alias("intent"), F.array_join(t, " ").alias("types"), F.md5(text.cast("binary")).alias("query_md5"))


@query("retrieval_states", """SELECT event_id, coalesce(mode, 'implement') AS mode, coalesce(mode, 'implement') IN ('debug', 'deploy') OR coalesce(stress, 'normal') = 'failure' OR coalesce(risk, 'medium') = 'high' AS prefer_exception, CASE WHEN coalesce(risk, 'medium') = 'high' THEN 'organization' ELSE 'project' END AS preferred_scope,
 CASE WHEN event_id % 4 = 0 THEN 'a,b' WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN 'own' END AS allowed FROM (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN NULL WHEN event_type = 'error' THEN 'debug' ELSE 'refactor' END AS mode, CASE WHEN event_id % 5 = 0 THEN 'failure' END AS stress, CASE WHEN event_id % 7 = 0 THEN 'high' END AS risk FROM events)""")
def retrieval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request says about how and where to retrieve."""
    i = F.col("event_id")
    mode = F.when(F.col("event_type") == "error", "debug").when(~F.col("event_type").isin("view", "click"), "refactor")
    s = P.retrieval_state(mode, F.when(i % 5 == 0, "failure"), F.when(i % 7 == 0, "high"))
    explicit = F.when(i % 4 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).when(i % 4 == 1, F.array().cast("array<string>"))
    e = table(spark, sf_dir, "events").select("event_id", s.alias("s"), P.allowed_workspaces(explicit, F.when(i % 4 == 2, "own")).alias("w"))
    return e.select("event_id", "s.mode", "s.prefer_exception", "s.preferred_scope", F.array_join("w", ",").alias("allowed"))


DIRECT = (("What is the branch name?", "branch_name", True), ("tell me the branch name", "branch_name", False), ("mật mã của kho là gì?", "verification_code", True), ("what is love?", None, False), ("the code, what is it?", "code", True))


@query("direct_answers", f"SELECT doc_id, [{', '.join(str(d[2]).lower() for d in DIRECT)}][doc_id % 5 + 1] AS direct FROM documents")
def direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*[F.lit(d[n]) for d in DIRECT]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", P.answered_directly(pick(0), pick(1)).alias("direct"))
