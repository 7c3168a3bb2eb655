"""Queries of the ranking family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import matching as M
from tidemark.operators import recall
from tidemark.operators import retrieval as R
from tidemark.plans.registry import query
from tidemark.sources.adapters import ASKED_SQL, MEMORIES_SQL, RECALLABLE_SQL, asked, memories, recallable, table

TOK = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1)"
DT = f"dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL)"
QT = f"qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL)"
COS = f"""{DT}, {QT}, dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM dt GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(qf * qf)) AS n FROM qt GROUP BY 1),
cs AS (SELECT item_id, doc_id, sum(tf * qf) / (any_value(dn.n) * any_value(qn.n)) AS cosine, count(*) AS overlap FROM dt JOIN qt USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY item_id, doc_id)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


@query("bm25_topk", f"""WITH {DT}, {QT}, l AS (SELECT doc_id, len({TOK}) AS dl FROM documents), k AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(dl) FROM l) AS a), df AS (SELECT term, count(*) AS df FROM dt GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)))::DOUBLE, 6) AS score FROM qt JOIN dt USING (term) JOIN df USING (term) JOIN l USING (doc_id), k GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir), 10)


@query("tf_cosine", f"WITH {COS} SELECT item_id, doc_id, round(cosine::DOUBLE, 6) AS cosine, overlap FROM cs WHERE overlap >= 5")
def tf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tf_cosine(_docs(spark, sf_dir), _queries(spark, sf_dir), 5).select("item_id", "doc_id", F.round("cosine", 6).alias("cosine"), "overlap")


@query("idf_coverage", f"""WITH {DT}, {QT}, df AS (SELECT term, count(*) AS df FROM dt GROUP BY 1), w AS (SELECT item_id, term, ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(df, 0))::DOUBLE) AS idf FROM qt LEFT JOIN df USING (term)),
m AS (SELECT item_id, sum(idf) AS mass FROM w GROUP BY 1) SELECT item_id, doc_id, round(sum(idf) / any_value(mass), 6) AS coverage FROM w JOIN dt USING (term) JOIN m USING (item_id) GROUP BY item_id, doc_id""")
def idf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.idf_coverage(_docs(spark, sf_dir), _queries(spark, sf_dir))


def _case(c: str, t: dict[str, float]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE 0 END"


_KIND = "CASE " + " ".join("WHEN " + " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in ps) + f" THEN '{n}'" for n, ps in L.QUERY_TYPES) + " ELSE 'factual' END"
_TYPE = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {_case('memory_type', t)}" for k, t in L.TYPE_SCORES.items()) + " ELSE 0 END"
NOW, STATE, FLOOR = "2026-06-01 00:00:00", {"mode": "m1", "risk_level": "high"}, 0.1
_AQT = QT.replace("benchmark", "asked")
_TIME = L.STATED_TIME.replace("(?iu)", "(?i)").replace("'", "''")
HYB = f"""{RECALLABLE_SQL}, {ASKED_SQL}, {DT}, {_AQT}, dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM dt GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(qf * qf)) AS n FROM qt GROUP BY 1),
cs AS (SELECT item_id, doc_id, sum(tf * qf) / (any_value(dn.n) * any_value(qn.n)) AS cosine, count(*) AS overlap FROM dt JOIN qt USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY item_id, doc_id),
kinds AS (SELECT *, {_KIND} AS kind FROM asked WHERE item_id IN (SELECT item_id FROM qt)),
pairs AS (SELECT k.item_id, k.kind, m.*, 2 * coalesce(cosine, 0) AS semantic, least(0.3 * coalesce(overlap, 0), 1.2)::DOUBLE AS lexical, coalesce(overlap, 0) AS overlap, CASE WHEN m.embedding IS NOT NULL AND k.embedding IS NOT NULL THEN list_cosine_similarity(list_transform(m.embedding, lambda x: x::DOUBLE), list_transform(k.embedding, lambda x: x::DOUBLE)) END AS near
  FROM recallable m JOIN kinds k ON (k.tenant IS NULL OR k.tenant = m.tenant) AND (k.workspace IS NULL OR m.workspace IS NULL OR k.workspace = m.workspace) AND CASE m.security_label WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 ELSE 3 END <= k.clearance
  LEFT JOIN cs ON cs.item_id = k.item_id AND cs.doc_id = m.memory_id),
parts AS (SELECT *, coalesce(2 * near, 0) AS embedding_part, (({_TYPE}) + CASE WHEN tag_mode = 'm1' THEN 2.25 ELSE 0 END + CASE WHEN memory_type IN ('policy', 'exception') THEN 0.45 ELSE 0 END
    + CASE WHEN ctx_mode = 'm1' THEN 0.35 WHEN ctx_mode IS NOT NULL THEN -0.5 ELSE 0 END + CASE WHEN ctx_risk = 'high' THEN 0.35 WHEN ctx_risk IS NOT NULL THEN -0.5 ELSE 0 END
    + CASE WHEN kind <> 'temporal' THEN 0 WHEN valid_from <= TIMESTAMP '{NOW}' AND (valid_to IS NULL OR TIMESTAMP '{NOW}' < valid_to) THEN 0.65 WHEN valid_from IS NOT NULL OR valid_to IS NOT NULL THEN 0.25 WHEN regexp_matches(content, '{_TIME}') THEN 0.55 ELSE 0 END)::DOUBLE AS by_kind,
  round((0.55 * confidence + 0.45 * trust_tier / 5 + 0.25 * utility + 0.20 * salience + least(0.04 * reinforcement, 0.25) - least(0.15 * contradiction, 0.75)
  + CASE WHEN lifecycle_state IN ('stable', 'reinforced') THEN 0.2 WHEN lifecycle_state IN ('challenged', 'deprecated', 'archived') THEN -0.8 ELSE 0 END
  + CASE WHEN memory_type <> 'exception' THEN 0 WHEN governed_exception_for IS NOT NULL AND approved_by IS NOT NULL AND epistemic_status <> 'simulated' AND (approval_expires_at IS NULL OR TIMESTAMP '{NOW}' < approval_expires_at) THEN 0.45 ELSE -1.5 END
  + {_case('epistemic_status', L.EPISTEMIC_SCORES)} + {_case('verification_status', L.VERIFICATION_SCORES)} + CASE WHEN epistemic_status = 'simulated' THEN -1.25 ELSE 0 END + CASE WHEN verification_status = 'unverified' THEN -0.55 ELSE 0 END
  - CASE WHEN label_junk THEN 0.6 ELSE 0 END + coalesce((label_importance - 5) * 0.03, 0))::DOUBLE, 9) AS strength FROM pairs WHERE CASE WHEN near IS NOT NULL THEN near >= {FLOOR} ELSE overlap > 0 END),
tot AS (SELECT *, round(semantic + lexical + embedding_part + by_kind + strength, 6) AS score, round(semantic + lexical + embedding_part + by_kind, 6) AS relevance FROM parts WHERE round(semantic + lexical + embedding_part + by_kind + strength, 6) > 0.05)"""
_SHOWN = "item_id, memory_id, score, rank, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(embedding_part, 6) AS embedding, round(by_kind, 6) AS by_kind, strength"


def _hybrid(spark: SparkSession, sf_dir: str, relevance_first: bool) -> DataFrame:
    at = F.lit(NOW).cast("timestamp_ntz")
    rows = recall.candidates(recallable(spark, sf_dir), at, at, STATE)
    return M.hybrid(rows, recall.questions(asked(spark, sf_dir)), 10, FLOOR, relevance_first).select("item_id", "memory_id", "score", "rank", "semantic", "lexical", "embedding", "by_kind", "strength")


@query("hybrid_recall", f"WITH {HYB}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, trust_tier DESC, confidence DESC, memory_id) AS rank FROM tot) SELECT {_SHOWN} FROM r WHERE rank <= 10")
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, False)


@query("relevance_first", f"""WITH {HYB}, s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, score DESC, trust_tier DESC, memory_id) AS n FROM tot),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, trust_tier DESC, confidence DESC, memory_id) AS rank FROM s WHERE n <= 10) SELECT {_SHOWN} FROM r""")
def relevance_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, True)


@query("active_exceptions", f"""WITH {RECALLABLE_SQL} SELECT memory_id, coalesce(governed_exception_for IS NOT NULL AND approved_by IS NOT NULL AND epistemic_status <> 'simulated' AND (approval_expires_at IS NULL OR TIMESTAMP '{NOW}' < approval_expires_at), false) AS active FROM recallable WHERE memory_type = 'exception'""")
def active_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which exceptions override their rule: approved, not simulated, not run out."""
    return recallable(spark, sf_dir).where("memory_type = 'exception'").select("memory_id", F.coalesce(recall.exception_active(F.lit(NOW).cast("timestamp_ntz")), F.lit(False)).alias("active"))


_SAYS = ("", " on 12/03/2026", " at 8:30", " last spring", " thứ hai", " hôm  qua", " in May 12", " room 1999x", " 5 PM", " Wednesday")


@query("stated_time", "SELECT doc_id, regexp_matches(x, '" + _TIME + "') AS states FROM (SELECT doc_id, left(coalesce(text, ''), 40) || ['" + "', '".join(_SAYS) + "'][doc_id % 10 + 1] AS x FROM documents)")
def stated_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts say when; endings of every shape are put behind the texts' beginnings, so that all of the pattern is met."""
    end = F.element_at(F.array(*[F.lit(s) for s in _SAYS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", recall.states_time(F.concat(F.left(F.coalesce("text", F.lit("")), F.lit(40)), end)).alias("states"))


@query("candidate_union", f"""WITH {MEMORIES_SQL}, a AS (SELECT memory_id, 0 AS stage, memory_id AS pos FROM memories WHERE regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}_])was($|[^\\p{{L}}\\p{{N}}_])')), b AS (SELECT memory_id, 1 AS stage, memory_id AS pos FROM memories WHERE memory_type IN ('policy', 'exception') ORDER BY memory_id LIMIT 100),
c AS (SELECT memory_id, 2 AS stage, -memory_id AS pos FROM memories ORDER BY memory_id DESC LIMIT 120), u AS (SELECT memory_id, min(struct_pack(s := stage, p := pos)) AS w FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY 1)
SELECT memory_id, w.s::INTEGER AS stage, w.p::BIGINT AS pos FROM u ORDER BY w.s, w.p, memory_id LIMIT 400""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    hit = m.where(F.array_contains(T.tokens(F.col("content")), "was")).select("memory_id", F.col("memory_id").alias("pos"))
    critical = m.where(F.col("memory_type").isin("policy", "exception")).orderBy("memory_id").limit(100).select("memory_id", F.col("memory_id").alias("pos"))
    recent = m.orderBy(F.desc("memory_id")).limit(120).select("memory_id", (-F.col("memory_id")).alias("pos"))
    return R.candidate_union([hit, critical, recent], "memory_id", 400)


VEC = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("cosine_topk", f"""WITH e AS (SELECT vec_id, {VEC} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS cosine FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return M.vector_topk(e, e.where("vec_id % 20 = 0"), 10)


@query("calibration_floor", f"""WITH e AS (SELECT vec_id, {VEC} AS v FROM embeddings ORDER BY md5('7|' || vec_id), vec_id LIMIT 200), s AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT count(*) AS pairs, round(quantile_disc(c, 0.5), 6) AS median, round(quantile_disc(c, 0.99), 6) AS p99, round(least(0.95, quantile_disc(c, 0.99) + 0.08), 6) AS floor FROM s""")
def calibration_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity floor from 200 vectors drawn by a seeded hash: calibration is a sampling operator."""
    seeded = F.md5(F.concat(F.lit("7|"), F.col("vec_id").cast("string")).cast("binary"))
    e = table(spark, sf_dir, "embeddings").orderBy(seeded, "vec_id").limit(200).select("vec_id", "embedding")
    a, b = (e.select(F.col("vec_id").alias(f"{x}_id"), F.col("embedding").alias(x)) for x in "ab")
    s = a.join(F.broadcast(b), F.col("a_id") < F.col("b_id")).select(S.cosine(F.col("a"), F.col("b")).alias("c"))
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY c)")
    return s.agg(F.count("*").alias("pairs"), F.round(p(0.5), 6).alias("median"), F.round(p(0.99), 6).alias("p99"), F.round(F.least(F.lit(0.95), p(0.99) + 0.08), 6).alias("floor"))


@query("topic_members", f"""WITH e AS (SELECT vec_id, label, {VEC} AS v FROM embeddings), t AS (SELECT label, v AS tv, vec_id AS t_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM e) WHERE n = 1),
s AS (SELECT label, vec_id, list_cosine_similarity(v, tv) AS c FROM e JOIN t USING (label) WHERE vec_id <> t_id), m AS (SELECT *, max(c) OVER (PARTITION BY label) AS best FROM s) SELECT label, vec_id, round(c, 6) AS cosine FROM m WHERE best >= 0.1 AND c >= 0.6 * best""")
def topic_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members near a topic's first vector, relative to the best one; a topic without a good enough best has none."""
    e = table(spark, sf_dir, "embeddings")
    topic = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("topic"), F.min("vec_id").alias("t_id"))
    s = e.join(topic, "label").where("vec_id <> t_id").select("label", "vec_id", S.cosine(F.col("embedding"), F.col("topic")).alias("c"))
    best = F.max("c").over(Window.partitionBy("label"))
    return s.withColumn("best", best).where("best >= 0.1 and c >= 0.6 * best").select("label", "vec_id", F.round("c", 6).alias("cosine"))


@query("embedding_coverage", "SELECT CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS model, len(embedding)::INTEGER AS dims, count(*) AS n, round(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS share FROM embeddings GROUP BY ALL")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("model"), F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / e.agg(F.count("*")).scalar(), 6))


@query("greedy_clusters")
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.greedy_clusters(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", 0.2)


@query("diverse_topk")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = M.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir), 20)
    terms = _docs(spark, sf_dir).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    return R.diverse(best.join(terms, "doc_id").select("item_id", "doc_id", "score", "terms"), "item_id", 5)


@query("hash_embeddings")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.embed(_queries(spark, sf_dir), R.hash_embedding).select("item_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


_BLK = """b AS (SELECT conv_id, turn AS block_id, md5(text) AS content_hash, greatest(1, (strlen(text) + 3) // 4)::BIGINT AS tokens,
 round((0.55 * (turn % 5) / 4.0 + 0.25 * CASE role WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.58 ELSE 0.95 END + 0.12 * (conv_id % 3) / 2.0 + 0.08 * (turn % 2))::DOUBLE, 6) AS score FROM conversations)"""


@query("context_pack", f"""WITH RECURSIVE {_BLK}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, tokens, block_id, content_hash) AS n FROM b),
f AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS used, []::VARCHAR[] AS seen, []::BIGINT[] AS ids FROM (SELECT DISTINCT conv_id FROM o)
 UNION ALL SELECT o.conv_id, o.n, CASE WHEN ok THEN used + tokens ELSE used END, CASE WHEN ok THEN list_append(seen, content_hash) ELSE seen END, CASE WHEN ok THEN list_append(ids, block_id) ELSE ids END
 FROM (SELECT o.*, f.used, f.seen, f.ids, NOT list_contains(f.seen, o.content_hash) AND f.used + o.tokens <= 400 AS ok FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1) o)
SELECT conv_id, used, len(ids)::INTEGER AS blocks, (SELECT sum(tokens)::BIGINT FROM b WHERE b.conv_id = f.conv_id) AS naive, array_to_string(ids, ',') AS ids FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "user", 1.0).when(F.col("role") == "assistant", 0.58).otherwise(0.95)
    score = F.round(0.55 * (F.col("turn") % 5) / 4.0 + 0.25 * role + 0.12 * (F.col("conv_id") % 3) / 2.0 + 0.08 * (F.col("turn") % 2), 6)
    blocks = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("block_id"), F.md5(F.col("text").cast("binary")).alias("content_hash"), T.token_estimate(F.col("text")).alias("tokens"), score.alias("score"))
    return R.packed(blocks, "conv_id", 400)


@query("exact_recall", """WITH f AS (SELECT user_id, event_type AS kind, CAST(floor(value / 50) AS INTEGER) AS v, count(*) AS r, max(ts) AS seen FROM events GROUP BY ALL), s AS (SELECT *, round((1.1 * (0.65 + 0.35 * (v % 2)) + 0.5 + 0.22 * log2(r + 1))::DOUBLE, 6) AS score FROM f),
w AS (SELECT *, row_number() OVER x AS n, lead(score) OVER x AS next_score, lead(v) OVER x AS next_v FROM s WINDOW x AS (PARTITION BY user_id, kind ORDER BY score DESC, v)) SELECT user_id, kind, v, score, coalesce(next_v <> v AND score - next_score < 0.35, false) AS conflict FROM w WHERE n = 1""")
def exact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest value of each fact, and whether the runner-up contests it."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("kind"), F.floor(F.col("value") / 50).cast("int").alias("v")).agg(F.count("*").alias("r"))
    score = F.round(S.exact_strength(0.65 + 0.35 * (F.col("v") % 2), F.lit(0.5), F.col("r"), F.lit(1e9), F.lit(0), F.lit("active")), 6)
    w = Window.partitionBy("user_id", "kind").orderBy(F.desc("score"), "v")
    s = e.withColumn("score", score).withColumn("n", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w)).withColumn("next_v", F.lead("v").over(w))
    return s.where("n = 1").select("user_id", "kind", "v", "score", F.coalesce((F.col("next_v") != F.col("v")) & (F.col("score") - F.col("next_score") < 0.35), F.lit(False)).alias("conflict"))
