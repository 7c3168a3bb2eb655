"""The engine's front: one object over a folder of append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.operators import audit, claims, matching, planner, recall
from tidemark.sources import stores

#: columns that a memory or question may lack: type and value that says nothing
MEMORY = {
    "tenant": ("string", None), "workspace": ("string", None), "security_label": ("string", "public"), "valid_from": ("timestamp_ntz", None), "valid_to": ("timestamp_ntz", None), "embedding": ("array<float>", None),
    "governed_exception_for": ("string", None), "approved_by": ("string", None), "approval_expires_at": ("timestamp_ntz", None), "tags": ("map<string,string>", None), "context": ("map<string,string>", None), "label_junk": ("boolean", None), "label_importance": ("double", None),
}
QUESTION = {"tenant": ("string", None), "workspace": ("string", None), "most": ("string", "restricted"), "embedding": ("array<float>", None)}


def filled(rows: DataFrame, wanted: dict[str, tuple[str, str | None]]) -> DataFrame:
    """rows with those columns that they lack."""
    return rows.withColumns({c: F.lit(v).cast(t) for c, (t, v) in wanted.items() if c not in rows.columns})


class MemoryEngine:
    """observe -> remember -> ask. Tables live under root: events, done, memories, tombstones. Nothing is ever rewritten."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _there(self, name: str) -> bool:
        """Whether the table was ever written. Only its absence means no; any other failure is raised."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def observe(self, events: DataFrame) -> None:
        """Appends observations that the log doesn't have yet, by event_id, in one write. events: event_id, subject, predicate,
        observed_at, bucket, kind. What they owe follows from the log (see jobs), so an append can't leave an event without its debt,
        and a repeated one changes nothing."""
        new = events.dropDuplicates(["event_id"])
        if self._there("events"):
            new = new.join(self._read("events").select("event_id"), "event_id", "left_anti").select(*events.columns)
        stores.append_events(new, f"{self.root}/events")

    def jobs(self, projections: tuple[str, ...] = ("memory",)) -> DataFrame:
        """The projections that the events owe, derived from the log; those in the done table are left out."""
        owed = stores.owed(self._read("events"), list(projections))
        return owed.join(self._read("done").select("projection_key"), "projection_key", "left_anti") if self._there("done") else owed

    def complete(self, jobs: DataFrame) -> None:
        """Marks jobs as done."""
        jobs.select("projection_key", "event_id", "projection_type").write.mode("append").parquet(f"{self.root}/done")

    def remember(self, memories: DataFrame) -> DataFrame:
        """Appends the memories that pass the immune gate, secrets taken out and scores clamped, and returns those that don't, with their risk."""
        ok, held = stores.governed(memories)
        ok.write.mode("append").parquet(f"{self.root}/memories")
        return held

    def forget(self, keys: DataFrame, restore: bool = False) -> None:
        """keys: memory_id. Places tombstones, which later reads honour, or lifts them."""
        keys.select("memory_id", F.lit(not restore).alias("placed"), F.expr("unix_micros(current_timestamp())").alias("seq")).write.mode("append").parquet(f"{self.root}/tombstones")

    def memories(self) -> DataFrame:
        rows = self._read("memories")
        return audit.without_tombstoned(rows, self._read("tombstones"), "memory_id") if self._there("tombstones") else rows

    def history(self) -> DataFrame:
        return claims.spans(self._read("events"))

    def state_at(self, at: Column | None = None) -> DataFrame:
        return claims.state_at(self.history(), at)

    def ever(self, value: int, known_by: Column | None = None) -> DataFrame:
        return claims.ever(self.history(), value, known_by)

    def recall(self, queries: DataFrame, top: int = 10, state: dict[str, str] | None = None, as_of: Column | None = None, relevance_first: bool = False) -> DataFrame:
        """queries: item_id, text, and tenant, workspace, most (label) and embedding where the asker has them. Hybrid ranking over
        the live memories that the asker may read; without a tenant, of all tenants."""
        m, q = filled(self.memories(), MEMORY), filled(queries, QUESTION)
        now = F.current_timestamp().cast("timestamp_ntz")
        return matching.hybrid(recall.candidates(m, now, as_of, state or {}), recall.questions(q), top, L.EMBEDDING_FLOOR, relevance_first)

    def ask(self, questions: DataFrame) -> DataFrame:
        """questions: text. Their frames and the operator that answers each."""
        return planner.framed(questions)

    def doctor(self, outbox: DataFrame, ledger: DataFrame, now: float) -> DataFrame:
        """All findings over the log, a queue of jobs and the ledger of what was projected."""
        return audit.doctor(self._read("events"), outbox, ledger, now)
