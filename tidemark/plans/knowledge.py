"""Queries of exact facts and rules. Texts are templates by doc_id, and the SQL states what each must give literally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators import facts as X
from tidemark.operators import rules as R
from tidemark.plans.registry import query
from tidemark.sources.adapters import CLAIMS_SQL, MEMORIES_SQL, claims, memories, table


def pick(values: list | tuple, key: str = "doc_id") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def lit(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def stated(rows: list[tuple], *columns: str, key: str = "doc_id", table_name: str = "documents", types: dict[str, str] | None = None) -> str:
    """SQL that gives each row of the table its template's expected columns. rows: (text, *expected)."""
    parts = [f"[{', '.join(lit(r[i + 1]) for r in rows)}][{key} % {len(rows)} + 1]" + (f"::{types[c]}" if types and c in types else "") + f" AS {c}" for i, c in enumerate(columns)]
    return f"SELECT {key}, {', '.join(parts)} FROM {table_name}"


def templated(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pick([r[0] for r in rows]).alias("x"))


FACTS = [
    ("The special character for project Atlas is delta seven.", "special_character_for_project_atlas", "delta seven"), ("password of the gate was blue heron", "verification_code_for_gate", "blue heron"),
    ("Ký tự đặc biệt là omega.", "special_character", "omega"), ("remember exactly: ninety nine steps", "special_character", "ninety nine steps"), ("The branch name is **release-7**", "branch_name", "release-7"),
    ("The weather is fine today", None, None), ("password is because of avoid", None, None), ("Remember that the tenant code is A-17!", "remember_that_tenant_code", "A-17"), ("", None, None),
    ("mật mã của kho là sen hồng", "verification_code", "sen hồng"),
]


@query("fact_extraction", stated(FACTS, "kind", "value"))
def fact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fact that each text states."""
    f = X.extracted(F.col("x"))
    return templated(spark, sf_dir, FACTS).select("doc_id", f.alias("f")).select("doc_id", F.col("f.kind").alias("kind"), F.col("f.value").alias("value"))


KINDS = [
    ("what is the special character for project Atlas?", "special_character_for_project_atlas"), ("what was the password of gate?", "verification_code_for_gate"), ("what is the branch name?", "branch_name"), ("what is love?", None),
    ("tên phiên bản là gì", "ten_phien_ban"), ("ký tự mật mã?", "special_character"), ("who came?", None),
]


@query("fact_kind_of_question", stated(KINDS, "kind"))
def fact_kind_of_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templated(spark, sf_dir, KINDS).select("doc_id", X.asked_kind(F.col("x")).alias("kind"))


ANCHORS = [
    ("the special character for unit nine is omega two.", "special_character", "unit nine", "omega two"), ("the password for vault is not known", None, None, None), ("code word is tulip", "verification_code", None, "tulip"),
    ("passphrase was never, ever written", None, None, None), ("ghi nhớ chính xác: bảy tám chín", "special_character", None, "bảy tám chín"), ("nothing to keep", None, None, None),
]


@query("anchor_facts", stated(ANCHORS, "kind", "subject", "value"))
def anchor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templated(spark, sf_dir, ANCHORS).select("doc_id", X.anchored(F.col("x")).alias("f")).select("doc_id", F.col("f.kind").alias("kind"), F.col("f.subject").alias("subject"), F.col("f.value").alias("value"))


SOURCES = [
    ("chat:user", None, "user", 1.0, "default"), ("jarvis", "", "assistant", 0.82, "default"), ("import", "assistant", "assistant", 0.82, "voice"), ("cron", None, "system", 0.65, "default"), ("web", "User", "user", 1.0, "mail,voice"),
]


@query("source_authority", f"SELECT doc_id, role, round(least(1.15, base + CASE WHEN doc_id % 2 = 0 THEN 0.08 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.06 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS authority, channels FROM ({stated([(r[0], *r[2:]) for r in SOURCES], 'role', 'base', 'channels')})")
def source_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a fact comes from, through which channels, and how far that is believed."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", pick([r[0] for r in SOURCES]).alias("source"), pick([r[1] for r in SOURCES]).alias("ref"), F.split(pick([r[4] if r[4] != "default" else "" for r in SOURCES]), ",").alias("named"))
    d = d.withColumn("role", X.source_role(F.col("source"), F.array(F.coalesce("ref", F.lit("")))))
    return d.select("doc_id", "role", F.round(X.authority(F.col("role"), i % 2 == 0, i % 3 == 0, i % 4 == 0), 6).alias("authority"), F.array_join(X.channels(F.col("named")), ",").alias("channels"))


@query("fact_remember", f"""WITH RECURSIVE {CLAIMS_SQL}, m AS (SELECT subject || ':' || predicate AS kind, bucket AS value, event_id AS seq, row_number() OVER (PARTITION BY subject, predicate, bucket ORDER BY event_id) AS nth FROM claims),
c AS (SELECT *, count(*) FILTER (nth = 1) OVER (PARTITION BY kind ORDER BY seq) AS came FROM m), v AS (SELECT kind, value, count(*) AS mentions, min(seq) AS first, min(seq) FILTER (nth = 3 AND came > 1) AS third FROM c GROUP BY ALL),
s AS (SELECT kind, min(third) AS ended FROM v GROUP BY 1 HAVING min(third) IS NOT NULL UNION ALL SELECT s.kind, (SELECT min(third) FROM v WHERE v.kind = s.kind AND v.first > s.ended) FROM s WHERE (SELECT min(third) FROM v WHERE v.kind = s.kind AND v.first > s.ended) IS NOT NULL),
l AS (SELECT kind, max(ended) AS last FROM s GROUP BY 1), n AS (SELECT kind, count(*) AS n, max(first) AS newest FROM v GROUP BY 1)
SELECT v.kind, v.value, v.mentions, CASE WHEN n = 1 THEN 'active' WHEN last IS NULL THEN 'conflicting' WHEN third = last AND newest < last THEN 'active' WHEN third = last OR first > last THEN 'conflicting' ELSE 'superseded' END AS state FROM v JOIN n USING (kind) LEFT JOIN l USING (kind)""")
def fact_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contested and settled values; see X.settled. A brute-force fold over all mentions is in the tests."""
    c = claims(spark, sf_dir)
    return X.settled(c.select(F.concat_ws(":", F.col("subject").cast("string"), "predicate").alias("kind"), F.col("bucket").alias("value"), F.col("event_id").alias("seq")))


@query("revalidation_packet", """WITH f AS (SELECT user_id AS scope, event_type AS kind, CAST(floor(value / 50) AS INTEGER)::VARCHAR AS value, count(*) AS r FROM events GROUP BY ALL), s AS (SELECT *, 0.65 + 0.35 * (value::INTEGER % 2) AS authority, round((1.1 * (0.65 + 0.35 * (value::INTEGER % 2)) + 0.5 + 0.22 * log2(r + 1))::DOUBLE, 6) AS score FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY scope, kind ORDER BY score DESC, value) AS n FROM s), p AS (SELECT scope, kind, list(value ORDER BY n) AS vals, list(score ORDER BY n) AS scores FROM t WHERE n <= 3 GROUP BY ALL)
SELECT scope, kind, len(vals) AS candidates, 'I have conflicting exact memories for ' || replace(kind, '_', ' ') || ': ' || array_to_string(vals, '; ') || '. Please confirm which value should remain canonical.' AS question FROM p WHERE len(vals) > 1 AND scores[1] - scores[2] < 0.35""")
def revalidation_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contested facts of each scope, and the question that would settle them."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scope"), F.col("event_type").alias("kind"), F.floor(F.col("value") / 50).cast("int").alias("v")).agg(F.count("*").alias("r"))
    authority = 0.65 + 0.35 * (F.col("v") % 2)
    f = e.select("scope", "kind", F.col("v").cast("string").alias("value"), authority.alias("authority"), F.round(S.exact_strength(authority, F.lit(0.5), F.col("r"), F.lit(1e9), F.lit(0), F.lit("active")), 6).alias("score"))
    return X.revalidation(f).select("scope", "kind", F.size("candidates").cast("bigint").alias("candidates"), "question")


RULES = [
    # text, scope, polarity, core words, domains, promotable, threshold, sensitive
    ("Never force push to the production branch", "project", "negative", "branch,force,production,push,the", "git_hotfix", True, 3, True),
    ("Allow hotfix force push only with approval and audit logging on production branch", "project", "positive", "and,approval,audit,branch,force,hotfix,logging,only,production,push,with", "git_hotfix", True, 3, True),
    ("Be careful and follow best practices", "project", "neutral", "and,best,careful,follow,practices", "", False, 2, False),
    ("Always keep the customer code before onboarding", "user", "positive", "before,code,customer,keep,onboarding,the", "tenant_code", False, 3, False),
    ("You must not rename the customer code", "user", "negative", "code,customer,rename,the,you", "tenant_code", True, 3, False),
    ("core values", "core", "neutral", "core,values", "", False, 999, True),
    ("Rename the customer code", "user", "neutral", "code,customer,rename,the", "tenant_code", False, 3, False),
    ("You should rename the customer code", "user", "positive", "code,customer,rename,the,you", "tenant_code", False, 3, False),
]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pick([r[0] for r in RULES]).alias("text"), pick([r[1] for r in RULES]).alias("scope"))


@query("rule_gates", stated(RULES, "scope", "polarity", "core", "domains", "promotable", "threshold", "approval", types={"threshold": "INTEGER"}))
def rule_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule says and about what, whether it may be promoted, how often it must be seen, and whether a person must agree."""
    t, s, c, i = F.col("text"), F.col("scope"), F.lit(0.7), F.lit(5)
    return R.described(_rules(spark, sf_dir)).select("doc_id", "scope", "polarity", F.array_join("core", ",").alias("core"), F.array_join("domains", ",").alias("domains"), R.promotable(t, s, c, i).alias("promotable"), R.promotion_threshold(t, s, i).alias("threshold"), R.needs_approval(t, s, c).alias("approval"))


#: relation of template i to template i + 1
RELATED = [("", "governed_exception", True), ("", "neutral", True), ("", "neutral", False), ("", "contradiction", True), ("", "neutral", False), ("", "neutral", False), ("", "neutral", True), ("", "neutral", False)]


@query("rule_relations", f"SELECT doc_id, relation, escalates, same_key FROM (SELECT *, true AS same_key FROM ({stated(RELATED, 'relation', 'escalates')}))")
def rule_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each rule relates to the next template's one, whether a closer look is due, and that the pair's key has no order."""
    n = len(RULES)
    rows = R.described(_rules(spark, sf_dir)).withColumn("t", F.col("doc_id") % n)
    side = F.struct("text", "scope", "polarity", "core", "domains", "conditional", "general")
    after = rows.groupBy(((F.col("t") + n - 1) % n).alias("t")).agg(F.any_value(side).alias("b"))
    pairs = rows.select("doc_id", "t", side.alias("a")).join(after, "t")
    return pairs.select("doc_id", R.relation("a", "b").alias("relation"), R.escalates("a", "b").alias("escalates"), (R.pair_key("a", "b") == R.pair_key("b", "a")).alias("same_key"))


PLACES = [
    # raw scope, topic, expected scope, bonus with project preferred, source, operational
    ("User", "", "user", 0.0, "hook:Stop", True), ("company", "", "organization", 0.0, "hook:Other", False), ("", "git push", "project", 0.35, "Stop", False), ("team", "", "project", 0.35, "a:b: PreToolUse", True), ("turn", "", "session", 0.0, "web:crawl", False),
    ("", "", "agent", 0.0, "x:Stop:y", False), ("core", "", "core", 0.30, ":SessionEnd", True),
]


@query("scope_rules", stated([(None, *p[2:4], p[5]) for p in PLACES], "scope", "bonus", "operational", types={"bonus": "DOUBLE"}))
def scope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope that a rule belongs to, what that is worth to a project's question, and whether its source is one of the tool's hooks."""
    d = table(spark, sf_dir, "documents").select("doc_id", pick([p[0] for p in PLACES]).alias("raw"), pick([p[1] for p in PLACES]).alias("topic"), pick([p[4] for p in PLACES]).alias("source"))
    none = F.lit(None).cast("string")
    d = d.withColumn("scope", R.normal_scope(F.col("raw"), F.col("topic"), none, none, F.lit(False)))
    return d.select("doc_id", "scope", R.scope_bonus(F.col("scope"), F.lit("project"), F.lit("medium")).alias("bonus"), R.operational(F.col("source")).alias("operational"))


@query("adaptive_effort", f"WITH {MEMORIES_SQL}, s AS (SELECT tenant, count(*) FILTER (memory_type = 'episodic') AS raw, count(*) FILTER (lifecycle_state = 'challenged') AS c FROM memories GROUP BY 1), p AS (SELECT memory_id, (raw > 1)::INTEGER + (c > 0)::INTEGER + (n_chars > 4000)::INTEGER + (memory_id % 10 >= 8)::INTEGER AS p FROM memories JOIN s USING (tenant)) SELECT memory_id, CASE WHEN p >= 4 THEN 'xhigh' WHEN p >= 3 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS effort FROM p")
def adaptive_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much work a new note is worth, by the store's pressure and its own weight. Raw notes are scaled to the small tables."""
    m = memories(spark, sf_dir)
    s = m.groupBy("tenant").agg(F.count_if(F.col("memory_type") == "episodic").alias("raw"), F.count_if(F.col("lifecycle_state") == "challenged").alias("c"))
    return m.join(s, "tenant").select("memory_id", R.effort(F.when(F.col("raw") > 1, 21).otherwise(0), F.col("c"), F.col("n_chars"), F.col("memory_id") % 10).alias("effort"))


OPPOSED = ["never keep the old branch around", "you should keep the old branch", "always keep the new index small", "keep the old branch", "avoid the new index now", "prefer tea"]


@query("text_conflicts", f"""WITH d AS (SELECT doc_id, lang, [{', '.join(lit(t) for t in OPPOSED)}][doc_id % 6 + 1] AS x, doc_id % 6 AS t FROM documents)
SELECT a.lang, a.doc_id AS left_id, b.doc_id AS right_id, CASE WHEN a.t + b.t = 1 THEN 4 ELSE 3 END::BIGINT AS shared FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id % 4 = 0 AND b.doc_id % 4 <> 0 AND ((a.t, b.t) IN ((0, 1), (1, 0), (2, 4), (4, 2)))""")
def text_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", pick(OPPOSED).alias("text"))
    left, right = d.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "left_id"), d.where("doc_id % 4 <> 0").withColumnRenamed("doc_id", "right_id")
    return R.text_conflicts(left, right, "lang")


@query("belief_conflict_drop", f"""WITH d AS (SELECT doc_id, lang, doc_id % 6 AS t, (doc_id % 101) / 100.0::DOUBLE + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END AS score FROM documents)
SELECT doc_id FROM d a WHERE doc_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM d b WHERE a.lang = b.lang AND b.doc_id % 4 <> 0 AND (a.t, b.t) IN ((0, 1), (1, 0), (2, 4), (4, 2)) AND b.score > a.score)""")
def belief_conflict_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs that no memory with a better score, provenance included, contradicts."""
    own = F.struct(F.col("lang").alias("workspace"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("task"))
    here = F.struct(F.lit("en").alias("workspace"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("task"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", pick(OPPOSED).alias("text"), (F.col("doc_id") % 101 / 100.0 + R.provenance(own, here)).alias("score"))
    left, right = d.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "left_id"), d.where("doc_id % 4 <> 0").withColumnRenamed("doc_id", "right_id")
    return R.kept_beliefs(left, right, "lang").select(F.col("left_id").alias("doc_id"))


@query("governed_exceptions", f"""WITH {MEMORIES_SQL} SELECT x.memory_id AS exception_id, g.memory_id AS rule_id, CASE WHEN x.trust_tier >= 4 THEN 12 WHEN x.confidence >= 0.5 THEN 24 ELSE 6 END::INTEGER AS hours FROM memories x JOIN memories g ON x.memory_id // 40 = g.memory_id // 40 AND x.memory_id % 8 = 1 AND g.memory_id % 8 = 0""")
def governed_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which permissions except which prohibitions of their team (forty memories each) and scope, and for how many hours they override them."""
    m = memories(spark, sf_dir)
    rules = m.select(F.col("memory_id").alias("id"), F.floor(F.col("memory_id") / 40).alias("team"), pick([r[0] for r in RULES], "memory_id").alias("text"), pick([r[1] for r in RULES], "memory_id").alias("scope"))
    hours = F.when(F.col("trust_tier") >= 4, 12).when(F.col("confidence") >= 0.5, 24).otherwise(6)
    return R.governed_pairs(rules, "team").join(m.select(F.col("memory_id").alias("exception_id"), hours.alias("hours")), "exception_id").select("exception_id", "rule_id", "hours")
