"""Queries of scalar functions, predicates and classifiers over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import governance as G
from tidemark.plans.registry import query
from tidemark.sources.adapters import MEMORIES_SQL, memories, table

q = lambda s: s.replace("'", "''")


def _contains(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{q(p)}')" for p in phrases) + ")"


def _fold(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1)"


@query("tokenise", f"SELECT doc_id, len({_TOKENS})::INTEGER AS n_tokens, len(list_distinct({_TOKENS}))::INTEGER AS n_distinct FROM documents")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("compact_text", "SELECT doc_id, length(text) > 1800 AS was_compacted, length(text)::INTEGER AS original_length, md5(CASE WHEN length(text) > 1800 THEN text[1:600] || chr(10) || '...[COMPACTED FOR MEMORY STABILITY]...' || chr(10) || text[-600:] ELSE text END) AS content_md5 FROM documents")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(t) > 1800).alias("was_compacted"), F.length(t).alias("original_length"), F.md5(T.compacted(t).cast("binary")).alias("content_md5"))


@query("chunk_text", "SELECT page_id, i::INTEGER AS pos, md5(substr(html, i * 500 + 1, 500)) AS chunk_md5 FROM pages, unnest(range(0, CAST(ceil(length(html) / 500) AS BIGINT))) AS u(i)")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.chunks(F.col("html"), 500)).alias("pos", "chunk")).select("page_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("token_estimate", "SELECT doc_id, greatest(1, (strlen(text) + 3) // 4)::BIGINT AS n FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n"))


@query("cheap_label", rf"""WITH t AS (SELECT conv_id, turn, {_fold('text')} AS x FROM conversations), b AS (SELECT *, regexp_replace(lower(x), '^[ .!?,:;]+|[ .!?,:;]+$', '', 'g') AS y FROM t),
j AS (SELECT *, length(y) <= 24 AND ({' OR '.join(f"y = '{q(m)}' OR starts_with(y, '{q(m)} ')" for m in L.JUNK_MARKERS)}) AS junk FROM b)
SELECT conv_id, turn, junk, CASE WHEN junk THEN 3 WHEN regexp_matches(x, '[0-9]') THEN 7 ELSE 5 END AS importance FROM j""")
def cheap_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    junk, importance = T.cheap_label(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", junk.alias("junk"), importance.alias("importance"))


_RED = "text"
for _p in (*L.SECRET_PATTERNS, L.TOKEN_ASSIGNMENT):
    _RED = f"regexp_replace({_RED}, '{q(_p)}', '[REDACTED]', 'gi')"


@query("security_scan", f"SELECT doc_id, {' OR '.join(f'''regexp_matches(lower(text), '{q(p)}')''' for p in L.INJECTION_PATTERNS)} AS injected, {_RED} <> text AS secret, md5({_RED}) AS redacted_md5 FROM documents")
def security_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    red = T.redacted(t, (L.TOKEN_ASSIGNMENT,))
    return table(spark, sf_dir, "documents").select("doc_id", T.injected(t).alias("injected"), (red != t).alias("secret"), F.md5(red.cast("binary")).alias("redacted_md5"))


@query("query_type", "SELECT item_id, CASE " + " ".join(f"WHEN {_contains('text', p)} THEN '{n}'" for n, p in L.QUERY_TYPES) + " ELSE 'factual' END AS kind FROM benchmark")
def query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.query_type(F.col("text")).alias("kind"))


@query("query_kind", f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{q(L.META)}', 'i') THEN 'meta' WHEN regexp_matches(text, '{q(L.SELF_HISTORY)}', 'i') THEN 'self_history' WHEN regexp_matches(text, '{q(L.TEMPORAL)}', 'i') THEN 'temporal' ELSE 'content' END AS kind FROM conversations")
def query_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_kind(F.col("text")).alias("kind"))


#: beginnings of a statement, and what each makes of it
FRAMES = (
    ("", "assert"), ("Nhắc lại, ", "repeat"), ("Đính chính: ", "correct"), ("Từ hôm nay, ", "supersede"), ("Theo một nguồn khác, ", "conflict"), ("Again,  ", "repeat"), ("Actually, ", "correct"),
    ("Xin lỗi, thông tin ", "correct"), ("As of ", "supersede"), ("Reportedly ", "conflict"),
)


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.element_at(F.array(*[F.lit(f) for f, _ in FRAMES]), (F.col("doc_id") % len(FRAMES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(frame, F.lit("lương của Phạm Nam vẫn là "), F.col("doc_id").cast("string"), F.lit(" triệu. ")).alias("x"))


@query("event_kind_of_text", f"SELECT doc_id, [{', '.join(repr(k) for _, k in FRAMES)}][doc_id % {len(FRAMES)} + 1] AS kind FROM documents")
def event_kind_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements do to an earlier one; the SQL states the kinds literally. "Still" inside a sentence doesn't make a repetition."""
    return _framed(spark, sf_dir).select("doc_id", T.event_kind(F.col("x")).alias("kind"))


@query("proposition_key", "SELECT doc_id, 'lương của phạm nam vẫn là ' || doc_id || ' triệu' AS key FROM documents")
def proposition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements claim, the same for every way of framing them."""
    return _framed(spark, sf_dir).select("doc_id", T.proposition(F.col("x")).alias("key"))


@query("time_sensitive", f"SELECT doc_id, regexp_matches(text, '{q(L.PERISHABLE)}', 'i') AS perishable, (doc_id % 200) >= 90 AND regexp_matches(text, '{q(L.PERISHABLE)}', 'i') AS stale FROM documents")
def time_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("text").rlike("(?iu)" + L.PERISHABLE)
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("perishable"), ((F.col("doc_id") % 200 >= L.STALE_AFTER_DAYS) & hit).alias("stale"))


@query("pii_counts", r"""SELECT source, count(*) AS docs, sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')))::BIGINT AS emails, sum(len(regexp_extract_all(text, '\+?[0-9][0-9 ()-]{7,}[0-9]')))::BIGINT AS phones,
 sum(len(regexp_extract_all(text, 'token\s*[:=]\s*[0-9a-f]{40}')))::BIGINT AS tokens, sum(n_chars)::BIGINT AS chars, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source""")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), n(r"\+?[0-9][0-9 ()-]{7,}[0-9]").alias("phones"), n(L.TOKEN_ASSIGNMENT).alias("tokens"),
        F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("answer_normal", r"""SELECT item_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[^\s]+'), lambda w: w NOT IN ('a', 'an', 'the')), ' ') AS norm FROM benchmark""")
def answer_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.answer_normal(F.col("text")).alias("norm"))


@query("fact_normal", r"""SELECT doc_id, md5(left(trim(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüýÿñçđ', 'aaaaaaeeeeiiiiooooouuuuyyncd'), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')), 220)) AS norm_md5 FROM documents""")
def fact_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fact_normal(F.col("text")).cast("binary")).alias("norm_md5"))


@query("event_checksum", "SELECT event_id, sha256(event_id || chr(31) || user_id || chr(31) || event_type || chr(31) || props) AS checksum, left(sha256(event_type || chr(31) || props), 16) AS conflict_key FROM events")
def event_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "events").select("event_id", T.content_hash(s("event_id"), s("user_id"), s("event_type"), s("props")).alias("checksum"), T.content_hash(s("event_type"), s("props"), width=16).alias("conflict_key"))


@query("checksum_verify", "SELECT CASE WHEN event_id % 50 = 0 THEN 'redacted' WHEN event_id % 37 = 0 THEN 'tampered' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def checksum_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputes the checksums of a log in which some payloads were altered and some lawfully erased."""
    e = table(spark, sf_dir, "events")
    s = lambda c: F.col(c).cast("string")
    stored = e.select("*", T.content_hash(s("event_id"), s("props")).alias("checksum"))
    now = stored.withColumn("props", F.when(F.col("event_id") % 37 == 0, "{}").otherwise(F.col("props")))
    erased = e.where(F.col("event_id") % 50 == 0).select("event_id", F.lit(True).alias("erased"))
    joined = now.join(erased, "event_id", "left")
    verdict = F.when(F.col("erased"), "redacted").when(T.content_hash(s("event_id"), s("props")) != F.col("checksum"), "tampered").otherwise("ok")
    return joined.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("acl_filter", f"""WITH {MEMORIES_SQL} SELECT memory_id, list_filter([CASE WHEN tenant <> 'src1' THEN 'tenant_mismatch' END, CASE WHEN workspace <> 'en' THEN 'workspace_mismatch' END,
  CASE WHEN security_label IN ('confidential', 'restricted') THEN 'security_label_exceeds_context' END], lambda x: x IS NOT NULL) AS denied FROM memories""")
def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.access(memories(spark, sf_dir), "src1", "en", "internal").select("memory_id", "denied")


@query("promotion_check", f"""WITH {MEMORIES_SQL}, m AS (SELECT *, memory_type IN ('identity', 'policy', 'exception', 'self_model') AS a, CASE WHEN memory_id % 3 = 0 THEN 'boss' END AS approved_by, memory_id % 8 <> 0 AS has_source FROM memories)
SELECT memory_id, array_to_string(list_filter([CASE WHEN a AND trust_tier < 4 THEN 'authoritative_memory_requires_human_approval' END, CASE WHEN a AND approved_by IS NULL THEN 'missing_approver' END, CASE WHEN a AND epistemic_status = 'simulated' THEN 'simulated_memory_cannot_be_authoritative' END,
  CASE WHEN NOT has_source THEN 'missing_provenance' END, CASE WHEN lifecycle_state = 'stable' AND confidence < 0.75 THEN 'stable_memory_confidence_too_low' END, CASE WHEN lifecycle_state = 'stable' AND verification_status = 'rejected' THEN 'rejected_memory_cannot_be_stable' END], lambda x: x IS NOT NULL), ',') AS blocked FROM m""")
def promotion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).withColumn("approved_by", F.when(F.col("memory_id") % 3 == 0, "boss")).withColumn("has_source", F.col("memory_id") % 8 != 0)
    return G.promotion(m).select("memory_id", F.array_join("blocked", ",").alias("blocked"))


@query("immune_risk", f"""WITH {MEMORIES_SQL}, s AS (SELECT *, ({' OR '.join(f'''regexp_matches(lower(content), '{q(p)}')''' for p in L.INJECTION_PATTERNS)} OR {' OR '.join(f'''regexp_matches(content, '{q(p)}', 'i')''' for p in L.SECRET_PATTERNS)}) AS scan FROM memories),
r AS (SELECT *, round(least(1.0, (CASE WHEN scan THEN 0.55 ELSE 0 END + CASE WHEN regexp_matches(lower(content), '{G.AUTHORITY_LANGUAGE}') THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(lower(content), '{G.TENANT_LANGUAGE}') THEN 0.45 ELSE 0 END
 + CASE WHEN epistemic_status = 'simulated' AND memory_type IN ('policy', 'identity', 'belief') THEN 0.6 ELSE 0 END + CASE WHEN trust_tier <= 1 AND memory_type IN ('policy', 'identity', 'procedural') THEN 0.35 ELSE 0 END + CASE WHEN memory_id % 5 = 0 THEN 0.1 ELSE 0 END)::DOUBLE), 6) AS risk FROM s)
SELECT memory_id, risk, scan OR risk >= 0.6 AS quarantined FROM r""")
def immune_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.when(F.col("memory_id") % 5 == 0, "web:crawl").otherwise("user")
    return G.immune(memories(spark, sf_dir), src).select("memory_id", "risk", "quarantined")


@query("prospective_triggers", """WITH s AS (SELECT user_id AS scope, event_type AS key, count(*) AS actual FROM events GROUP BY ALL), c(trigger_id, priority, key, op, wanted) AS (VALUES (1, 5, 'error', 'gte', 12), (1, 5, 'purchase', 'lte', 14), (2, 9, 'signup', 'eq', 13), (3, 1, 'view', 'gte', 10), (3, 1, 'click', 'gte', 10)), n AS (SELECT trigger_id, count(*) AS need FROM c GROUP BY 1)
SELECT scope, trigger_id, priority FROM s JOIN c USING (key) JOIN n USING (trigger_id) GROUP BY scope, trigger_id, priority, need HAVING count(*) FILTER (CASE op WHEN 'eq' THEN actual = wanted WHEN 'gte' THEN actual >= wanted ELSE actual <= wanted END) = need""")
def prospective_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scope"), F.col("event_type").alias("key")).agg(F.count("*").alias("actual"))
    rules = spark.createDataFrame([(1, 5, "error", "gte", 12), (1, 5, "purchase", "lte", 14), (2, 9, "signup", "eq", 13), (3, 1, "view", "gte", 10), (3, 1, "click", "gte", 10)], "trigger_id int, priority int, key string, op string, wanted int")
    return G.triggers(rules, state)


@query("class_selection", "WITH c AS (SELECT *, json_extract_string('{\"class\": ' || chr(34) || CASE WHEN quality = 1 THEN 'lesson' ELSE 'mistake' END || chr(34) || '}', '$.class') AS cls FROM labels) SELECT doc_id, cls FROM c WHERE cls = 'mistake' ORDER BY doc_id DESC LIMIT 50")
def class_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.to_json(F.struct(F.when(F.col("quality") == 1, "lesson").otherwise("mistake").alias("class")))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.get_json_object(meta, "$.class").alias("cls"))
    return rows.where(F.col("cls").isin("mistake")).orderBy(F.desc("doc_id")).limit(50)


@query("class_coverage", "SELECT count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 0) AS low FROM documents d LEFT JOIN labels l USING (doc_id)")
def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("has"))
    return table(spark, sf_dir, "documents").select("doc_id").join(lab, "doc_id", "left").agg(F.count("*").alias("documents"), F.count("has").alias("labelled"), F.count_if(F.col("quality") == 0).alias("low"))


@query("subject_mentions", r"""WITH t AS (SELECT doc_id, lower(text) AS x, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents) SELECT count(*) FILTER (list_has_all(w, ['the', 'in', 'that'])) AS whole_words, count(*) FILTER (contains(x, 'the') AND contains(x, 'in') AND contains(x, 'that')) AS substrings FROM t""")
def subject_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word mention for reading, substring mention for deletion."""
    parts = F.array(*[F.lit(p) for p in ("the", "in", "that")])
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    low = F.lower("text")
    sub = low.contains("the") & low.contains("in") & low.contains("that")
    return table(spark, sf_dir, "documents").agg(F.count_if(F.size(F.array_except(parts, words)) == 0).alias("whole_words"), F.count_if(sub).alias("substrings"))


@query("scalar_scores", """SELECT event_id, round(least(300.0, 2.0 * 2.0 ** (event_id % 9 - 1))::DOUBLE, 6) AS wait, round(least(4.0, 1 + 0.6 * ln(1 + event_id % 50))::DOUBLE, 6) AS durability,
 round(exp(-0.05 * 0.7 / least(4.0, greatest(1.0, 1 + 0.6 * ln(1 + event_id % 50))) * (event_id % 365))::DOUBLE, 6) AS decay,
 round((1.1 * 0.82 + 0.5 + 0.22 * log2(event_id % 6 + 2) + 0.35 * exp(-0.06 * (event_id % 90)) - 0.18 * (event_id % 3) - CASE WHEN event_id % 4 = 0 THEN 0.35 WHEN event_id % 4 = 1 THEN 1.2 ELSE 0 END)::DOUBLE, 6) AS strength FROM events""")
def scalar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    durable = S.durability(i % 50)
    state = F.when(i % 4 == 0, "conflicting").when(i % 4 == 1, "superseded").otherwise("active")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(S.backoff(i % 9), 6).alias("wait"), F.round(durable, 6).alias("durability"), F.round(S.l2_decay(F.lit("semantic"), durable, i % 365), 6).alias("decay"),
        F.round(S.exact_strength(F.lit(0.82), F.lit(0.5), i % 6 + 1, i % 90, i % 3, state), 6).alias("strength"))


@query("placement_tier", """WITH s AS (SELECT doc_id, 0.24 * (doc_id % 11) / 10.0 + 0.18 * (doc_id % 7) / 6.0 + 0.18 * (doc_id % 5) / 4.0 + 0.14 * (doc_id % 3) / 2.0 + 0.18 * (doc_id % 13) / 12.0 + 0.08 * (doc_id % 2) AS x FROM documents)
SELECT doc_id, round(x::DOUBLE, 6) AS score, CASE WHEN round(x::DOUBLE, 6) >= 0.78 THEN 'hot' WHEN round(x::DOUBLE, 6) >= 0.58 THEN 'warm' WHEN round(x::DOUBLE, 6) >= 0.32 THEN 'cold' ELSE 'archive' END AS tier FROM s""")
def placement_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    score = F.round(S.placement(i % 11 / 10.0, i % 7 / 6.0, i % 5 / 4.0, i % 3 / 2.0, i % 13 / 12.0, (i % 2).cast("double")), 6)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), S.tier(score).alias("tier"))


@query("context_match", "SELECT event_id, round(((CAST(event_type = 'error' AS INTEGER) + CAST(event_id % 3 = 1 AS INTEGER)) * 0.35 - (2 - CAST(event_type = 'error' AS INTEGER) - CAST(event_id % 3 = 1 AS INTEGER)) * 0.5)::DOUBLE, 6) AS score FROM events")
def context_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of a memory's applicable context (a map) with the asker's state."""
    context = F.create_map(F.lit("type"), F.col("event_type"), F.lit("mode"), (F.col("event_id") % 3).cast("string"))
    state = F.create_map(F.lit("type"), F.lit("error"), F.lit("mode"), F.lit("1"), F.lit("goal"), F.lit("x"))
    shared = F.map_filter(context, lambda k, v: F.map_contains_key(state, k))
    score = F.aggregate(F.map_entries(shared), F.lit(0.0), lambda acc, e: acc + F.when(state[e["key"]] == e["value"], 0.35).otherwise(-0.5))
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))
