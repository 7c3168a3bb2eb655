"""Queries of running the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators import lifecycle, planner
from tidemark.operators import operations as O
from tidemark.plans.audits import NOW
from tidemark.plans.planning import _U, _about_people, _pick
from tidemark.plans.registry import query
from tidemark.sources.adapters import CLAIMS_SQL, LEDGER_SQL, OUTBOX_SQL, claims, ledger, outbox, table
from tidemark.streaming import projection as P

WANTED = {"events": "event_id bigint, ts timestamp_ntz, payload string", "documents": "doc_id int, text string", "tombstones": "memory_id bigint"}


@query("schema_check", "SELECT * FROM (VALUES ('events', 'payload', 'missing_column'), ('documents', 'doc_id', 'is_bigint'), ('tombstones', NULL, 'missing_table')) t(table_name, column_name, problem)")
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tables differ from what is declared."""
    return O.schema_report(spark, {n: table(spark, sf_dir, n) for n in ("events", "documents")}, WANTED)


@query("log_faults", "SELECT 'duplicate_event' AS code, event_id, 2::BIGINT AS n FROM events WHERE event_id % 50 = 0 UNION ALL SELECT 'missing_checksum', event_id, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END FROM events WHERE event_id % 30 = 0")
def log_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 30 != 0, F.md5("props")).alias("checksum"))
    return O.log_faults(e.unionByName(e.where("event_id % 50 = 0")))


@query("doctor_cursors", f"""WITH {CLAIMS_SQL}, s AS (SELECT subject % 7 AS scope, max(event_id) AS top_id, count(*) FILTER (kind = 'correct' AND predicate = 'signup' AND subject % 7 = 3) AS findings FROM claims GROUP BY 1),
r AS (SELECT *, CASE scope WHEN 6 THEN 'none_stored' WHEN 0 THEN 'discarded_version' WHEN 1 THEN 'discarded_schema' END AS fresh FROM s)
SELECT scope, coalesce(fresh, CASE WHEN findings > 0 THEN 'held_by_findings' ELSE 'advanced' END) AS reason, CASE WHEN fresh IS NOT NULL THEN 0 ELSE 100 + scope END::BIGINT AS start_id, CASE WHEN findings > 0 THEN CASE WHEN fresh IS NOT NULL THEN 0 ELSE 100 + scope END ELSE greatest(top_id, CASE WHEN fresh IS NOT NULL THEN 0 ELSE 100 + scope END) END::BIGINT AS next_id FROM r""")
def doctor_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each scope's next audit starts."""
    c = claims(spark, sf_dir)
    scope = (F.col("subject") % 7).alias("scope")
    seen = c.groupBy(scope).agg(F.max("event_id").alias("top_id"), F.count_if((F.col("kind") == "correct") & (F.col("predicate") == "signup") & (F.col("subject") % 7 == 3)).alias("findings"))
    now = O.fingerprint(c.schema)
    s = F.col("scope")
    stored = c.select(scope).distinct().where("scope <> 6").select("scope", (s + 100).alias("last_id"), F.when(s == 0, O.DOCTOR_VERSION - 1).otherwise(O.DOCTOR_VERSION).alias("doctor_version"), F.when(s == 1, "older").otherwise(now).alias("schema_fingerprint"))
    return O.cursors(stored, seen, O.DOCTOR_VERSION, now)


_CODES = ("stale_lease", "attempts_exhausted", "completed_without_projection", "key_mismatch", "skipped_with_ledger", "duplicate_jobs")


@query("repair_apply", f"""WITH {LEDGER_SQL}, p AS (SELECT job_id, [{', '.join(f"'{c}'" for c in _CODES)}][event_id % 6 + 1] AS code, event_id, projection_type, CASE WHEN event_id % 5 = 0 THEN 'dead' ELSE status END AS status, projection_key FROM outbox),
b AS (SELECT p.*, EXISTS (SELECT 1 FROM ledger l WHERE l.event_id = p.event_id AND l.projection_type = p.projection_type) AS built, sha256(event_id || chr(31) || projection_type) AS owed FROM p),
o AS (SELECT *, CASE code WHEN 'stale_lease' THEN status = 'in_progress' WHEN 'attempts_exhausted' THEN status <> 'dead' WHEN 'completed_without_projection' THEN status = 'completed' AND NOT built WHEN 'skipped_with_ledger' THEN status = 'skipped' AND built WHEN 'key_mismatch' THEN projection_key <> owed END AS ok FROM b)
SELECT code, job_id, CASE WHEN ok IS NULL THEN 'refused' WHEN ok THEN 'applied' ELSE 'stale' END AS outcome, CASE WHEN ok AND code IN ('stale_lease', 'completed_without_projection') THEN 'pending' WHEN ok AND code = 'attempts_exhausted' THEN 'dead' WHEN ok AND code = 'skipped_with_ledger' THEN 'completed' ELSE status END AS status,
  CASE WHEN ok AND code = 'key_mismatch' THEN owed ELSE projection_key END AS projection_key FROM o""")
def repair_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs planned for jobs, some of which have died since: only those whose precondition still holds change anything."""
    box = outbox(spark, sf_dir)
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("event_id") % 6 + 1).cast("int"))
    plan = box.select(code.alias("code"), "job_id")
    return O.repaired(plan, box.withColumn("status", F.when(F.col("event_id") % 5 == 0, "dead").otherwise(F.col("status"))), ledger(spark, sf_dir))


@query("replay_dry_run", f"""WITH {OUTBOX_SQL}, t AS (SELECT event_id, unnest(['memory', 'label', 'archive']) AS projection_type FROM events), l AS (SELECT event_id, projection_type, arg_max(status, projection_version) AS status, arg_max(locked_at, projection_version) AS locked_at, max(projection_version) AS v FROM outbox GROUP BY ALL),
s AS (SELECT t.*, CASE WHEN l.event_id IS NULL THEN 'missing' WHEN status = 'pending' THEN 'pending' WHEN status = 'in_progress' AND {NOW} - locked_at > 3600 THEN 'stale' WHEN status = 'dead' THEN 'dead' WHEN v <> 1 THEN 'version_drift' ELSE 'done' END AS state FROM t LEFT JOIN l USING (event_id, projection_type))
SELECT s.projection_type, s.state, CASE WHEN s.state = 'done' THEN 'done' WHEN s.event_id % 9 = 0 THEN 'skipped_tombstoned' WHEN s.projection_type = 'archive' THEN 'skipped_unreplayable' WHEN s.projection_type = 'label' AND p.state <> 'done' THEN 'held_by_dependency' ELSE 'replay' END AS verdict, count(*) AS n
FROM s LEFT JOIN s p ON s.projection_type = 'label' AND p.event_id = s.event_id AND p.projection_type = 'memory' GROUP BY ALL""")
def replay_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay would do, and what it leaves alone, by reason."""
    e = table(spark, sf_dir, "events")
    scan = A.replay_scan(e, outbox(spark, sf_dir), {"memory": 1, "label": 1, "archive": 1}, NOW)
    return O.replayed(scan, e.where("event_id % 9 = 0"), ("memory", "label")).groupBy("projection_type", "state", "verdict").agg(F.count("*").alias("n"))


@query("queue_reset", f"WITH {OUTBOX_SQL} SELECT job_id, CASE WHEN status = 'dead' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead' THEN 0 ELSE attempts END::INTEGER AS attempts, CASE WHEN status <> 'dead' THEN last_error END AS last_error, locked_by FROM outbox")
def queue_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead jobs start again."""
    box = outbox(spark, sf_dir)
    return O.reset(box, box.where("status = 'dead'")).select("job_id", "status", "attempts", "last_error", "locked_by")


@query("queue_views", f"WITH {OUTBOX_SQL} SELECT 'pending' AS view, job_id FROM outbox WHERE status = 'pending' UNION ALL SELECT 'dead_letter', job_id FROM outbox WHERE status = 'dead' UNION ALL SELECT 'stale', job_id FROM outbox WHERE status = 'in_progress' AND {NOW} - locked_at > 300")
def queue_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.queue_views(outbox(spark, sf_dir), NOW, 300.0)


@query("lease_domain", "SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def lease_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leases could be held: finite and positive."""
    i = F.col("event_id")
    lease = F.when(i % 4 == 0, F.lit(30.0)).when(i % 4 == 1, F.lit(0.0)).when(i % 4 == 2, F.lit(float("inf"))).when(i % 8 == 3, F.lit(float("nan")))
    return table(spark, sf_dir, "events").select("event_id", O.valid_lease(lease).alias("valid"))


@query("dependency_gate", f"WITH {OUTBOX_SQL}, j AS (SELECT event_id, 'memory' AS projection_type, status FROM outbox UNION ALL SELECT event_id, 'label', 'pending' FROM events WHERE event_id % 3 = 0) SELECT event_id, 'label' AS projection_type, CASE WHEN EXISTS (SELECT 1 FROM outbox o WHERE o.event_id = c.event_id AND status = 'completed') THEN 'ready' WHEN EXISTS (SELECT 1 FROM outbox o WHERE o.event_id = c.event_id AND status = 'dead') THEN 'blocked' ELSE 'held' END AS gate FROM events c WHERE event_id % 3 = 0")
def dependency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels may be made: their event's memory is there, can never be, or isn't yet."""
    parents = outbox(spark, sf_dir).select("event_id", F.lit("memory").alias("projection_type"), "status")
    children = table(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_id", F.lit("label").alias("projection_type"), F.lit("pending").alias("status"))
    return O.dependency_state(parents.unionByName(children))


@query("determinism", "SELECT count(*) AS events, 0::BIGINT AS unstable, md5(string_agg(sha256(event_id || chr(31) || user_id || chr(31) || event_type || chr(31) || coalesce(props, '')), '' ORDER BY event_id)) AS digest FROM events")
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rebuilds from differently dealt logs give one hash an event, and the same hashes as SQL."""
    e = table(spark, sf_dir, "events")
    dealt = [e.repartition(1), e.repartition(5, "user_id"), e.repartitionByRange(3, F.desc("event_id"))]
    per = O.determinism([O.canonical(d, ["event_id", "user_id", "event_type", "props"]) for d in dealt])
    return per.agg(F.count("*").alias("events"), F.count_if((F.col("hashes") != 1) | (F.col("builds") != 3)).alias("unstable"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "hash"))), lambda x: x["hash"]), "").cast("binary")).alias("digest"))


@query("execution_report", f"{_U}, a AS (SELECT user_id, {_pick(8)} AS op FROM u) SELECT count(*) AS questions, count(*) AS structured, count(*) AS structured_taken, count(*) FILTER (op = 'state' AND false) AS fallbacks, 0.0::DOUBLE AS fallback_rate FROM a")
def execution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.execution_report(planner.framed(_about_people(spark, sf_dir)))


@query("baseline_compare", """WITH b AS (SELECT event_type AS family, round(avg((value > 50)::INTEGER), 6) AS before FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY 1), n AS (SELECT event_type AS family, round(avg((value > 55)::INTEGER), 6) AS after FROM events WHERE event_id % 2 = 1 AND event_type <> 'click' GROUP BY 1)
SELECT family, before, after, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' WHEN after - before < -0.02 THEN 'regressed' WHEN after - before > 0.02 THEN 'improved' ELSE 'same' END AS verdict FROM b FULL JOIN n USING (family)""")
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against its baseline, family by family."""
    e = table(spark, sf_dir, "events")
    score = lambda rows, least: rows.groupBy(F.col("event_type").alias("family")).agg(F.round(F.avg((F.col("value") > least).cast("int")), 6).alias("score"))
    return O.compared(score(e.where("event_id % 2 = 0 and event_type <> 'view'"), 50), score(e.where("event_id % 2 = 1 and event_type <> 'click'"), 55))


@query("frozen_sources", "SELECT 'events' AS source, (SELECT count(*) FROM events) AS n, true AS unchanged, true AS change_found UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), true, true")
def frozen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's digest survives a new order of its rows and no change of a value."""
    out = None
    for name, key in (("events", "event_id"), ("documents", "doc_id")):
        t = table(spark, sf_dir, name)
        changed = t.withColumn(key, F.when(F.col(key) == t.agg(F.max(key)).scalar(), -1).otherwise(F.col(key)))
        a, b, c = (O.content_digest(x).select(F.col("digest").alias(n), F.col("n").alias(f"n_{n}")) for n, x in (("a", t), ("b", t.repartition(7)), ("c", changed)))
        row = a.crossJoin(b).crossJoin(c).select(F.lit(name).alias("source"), F.col("n_a").alias("n"), (F.col("a") == F.col("b")).alias("unchanged"), (F.col("a") != F.col("c")).alias("change_found"))
        out = row if out is None else out.unionByName(row)
    return out


_FAULT = "(('0x' || left(sha256(event_id::VARCHAR), 8))::BIGINT::DOUBLE / 4294967295.0)"


@query("fault_buckets", f"SELECT CASE WHEN {_FAULT} < 0.80 THEN 'normal' WHEN {_FAULT} < 0.88 THEN 'transient' WHEN {_FAULT} < 0.92 THEN 'stale_lease' WHEN {_FAULT} < 0.95 THEN 'dependency' WHEN {_FAULT} < 0.97 THEN 'skipped' WHEN {_FAULT} < 0.99 THEN 'permanent' ELSE 'duplicate' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def fault_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fault a benchmark injects for how many events."""
    return table(spark, sf_dir, "events").groupBy(O.fault_of(F.col("event_id")).alias("bucket")).agg(F.count("*").alias("n"))


@query("overhead_ratio", "WITH a AS (SELECT event_type, quantile_disc(value, 0.95) AS loaded FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, quantile_disc(value, 0.95) AS plain FROM events WHERE user_id % 2 = 1 GROUP BY 1) SELECT event_type, loaded, plain, round(loaded / plain, 6) AS ratio FROM a JOIN b USING (event_type)")
def overhead_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return O.overhead(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), "event_type", "value")


@query("undeclared_stores", "SELECT unnest(['conversations', 'pages']) AS store")
def undeclared_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with texts that no privacy declaration names."""
    names = ("events", "documents", "labels", "pages", "conversations", "embeddings")
    with_text = {n for n in names if any(f.dataType.simpleString() == "string" for f in table(spark, sf_dir, n).schema)}
    return spark.createDataFrame([(n,) for n in lifecycle.undeclared({"events", "documents"}, with_text)], "store string")


@query("projection_order", "SELECT * FROM (VALUES (1::BIGINT, 'memory'), (2, 'embedding'), (3, 'label'), (4, 'summary')) t(step, projection)")
def projection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections in an order in which each comes after what it needs."""
    order = lifecycle.topological({"summary": ["label", "embedding"], "label": ["memory"], "embedding": ["memory"], "memory": []})
    return spark.createDataFrame(list(enumerate(order, 1)), "step long, projection string")


@query("stream_dependencies", "SELECT DISTINCT c.event_id AS child_id, p.event_id AS parent_id FROM events c JOIN events p ON p.user_id = c.user_id AND c.event_type = 'purchase' AND p.event_type = 'signup' AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 2 DAY")
def stream_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children let through once their parent has come, both from streams; state ends with the watermarks."""
    return P.drained(P.dependent(P.events_stream(spark, f"{sf_dir}/events.parquet"), P.events_stream(spark, f"{sf_dir}/events.parquet"), "2 days"), "dependent")


@query("drain_report", "SELECT * FROM (SELECT 'paused' AS step, 0::BIGINT AS projected, 0::BIGINT AS unresolved UNION ALL SELECT 'drained', (SELECT count(*) FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 17 <> 0), (SELECT count(*) FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 17 = 0) UNION ALL SELECT 'again', (SELECT count(*) FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 17 <> 0), (SELECT count(*) FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 17 = 0))")
def drain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paused projection does nothing; a drain ignores the pause, runs until nothing is owed that can be done, and names the rest. A
    second drain has no further effect."""
    control = P.Control(spark, f"{sf_dir}/events.parquet", F.col("event_id") % 17 != 0)
    control.pause()
    out = [("paused", *control.run())]
    out.append(("drained", *control.drain()))
    out.append(("again", *control.drain()))
    return spark.createDataFrame(out, "step string, projected long, unresolved long")


@query("projector_process", f"""WITH {LEDGER_SQL}, j AS (SELECT job_id, event_id, projection_type, status, projection_key FROM outbox UNION ALL SELECT 'again-' || event_id, event_id, 'label', 'pending', 'label-' || (event_id // 3) FROM outbox WHERE projection_type = 'memory' AND event_id % 3 <> 2),
o AS (SELECT *, CASE WHEN projection_type = 'label' THEN CASE WHEN EXISTS (SELECT 1 FROM j p WHERE p.event_id = j.event_id AND p.projection_type = 'memory' AND p.status = 'completed') THEN 'ready' WHEN EXISTS (SELECT 1 FROM j p WHERE p.event_id = j.event_id AND p.projection_type = 'memory') AND NOT EXISTS (SELECT 1 FROM j p WHERE p.event_id = j.event_id AND p.projection_type = 'memory' AND p.status <> 'dead') THEN 'blocked' ELSE 'held' END END AS gate FROM j),
r AS (SELECT *, CASE WHEN projection_key IN (SELECT projection_key FROM ledger) THEN 'completed_already' WHEN event_id % 11 = 0 THEN 'skipped_tombstoned' WHEN gate = 'held' THEN 'held' WHEN gate = 'blocked' THEN 'dead_lettered' ELSE 'built' END AS outcome, row_number() OVER (PARTITION BY projection_key ORDER BY job_id) AS n FROM o WHERE status IN ('pending', 'in_progress'))
SELECT job_id, projection_key, CASE WHEN outcome = 'built' AND n > 1 THEN 'completed_already' ELSE outcome END AS outcome FROM r""")
def projector_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a worker does with every open job; some share a key, some wait for another of their event."""
    box = outbox(spark, sf_dir).select("job_id", "event_id", "projection_type", "status", "projection_key")
    more = box.where("projection_type = 'memory' and event_id % 3 <> 2").select(F.concat(F.lit("again-"), F.col("event_id").cast("string")), "event_id", F.lit("label"), F.lit("pending"), F.concat(F.lit("label-"), F.floor(F.col("event_id") / 3).cast("string")))
    gone = table(spark, sf_dir, "events").where("event_id % 11 = 0").select("event_id")
    return O.processed(box.union(more), ledger(spark, sf_dir), gone, NOW).select("job_id", "projection_key", "outcome")


@query("json_defaults", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE k END AS k, event_id % 3 <> 0 AS given FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON with a default where it is broken or missing."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 != 0, F.col("props")).when(i % 2 == 0, "{broken").alias("props"))
    return O.decoded(e, "props", "k int").select("event_id", F.col("props.k").alias("k"), F.col("props.k").isNotNull().alias("given"))
