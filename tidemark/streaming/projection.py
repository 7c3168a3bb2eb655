"""Append -> project with Structured Streaming: idempotent effects, retries with state, windows, incremental audits.

foreachBatch runs at least once, so every sink here is keyed: a batch writes the folder of its own number, which a repeated run
overwrites with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.text import content_hash
from tidemark.sources.scratch import folder


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a Parquet log, a folder or a single file; the schema comes from those already there.

    The file source takes a single file only as a pattern, so the last letter becomes one.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs the stream over all that is there now and returns what its batches wrote. In complete mode the last batch's rows count."""
    spark = stream.sparkSession
    out, checkpoint = folder(spark, name), folder(spark, f"{name}-state")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{out}/batch={max(last)}"] if mode == "complete" else [f"{out}/batch={n}" for n in sorted(set(last))]
    return spark.read.parquet(*paths)


def project(stream: DataFrame, tombstones: DataFrame | None = None, late: str = "10 days") -> DataFrame:
    """Owed events, once a projection key, without tombstoned ones. The key's memory ends with the watermark."""
    key = content_hash(F.col("event_id").cast("string"), F.col("event_type"))
    owed = stream.where(F.col("event_type").isin("purchase", "signup")).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("projection_key", key)
    once = owed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["projection_key"])
    return once.join(tombstones, "event_id", "left_anti") if tombstones is not None else once


def windowed(stream: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def retries(stream: DataFrame, most: int = 5) -> DataFrame:
    """Failures of each user so far; from `most` on the user's job is dead. State is one counter a key."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "attempts": [n], "status": ["dead" if n >= most else "pending"]})

    failed = stream.where("event_type = 'error'").select("user_id", "event_id")
    return failed.groupBy("user_id").applyInPandasWithState(count, "user_id long, attempts long, status string", "n long", "update", GroupStateTimeout.NoTimeout)


def dependent(children: DataFrame, parents: DataFrame, within: str, late: str = "1 day") -> DataFrame:
    """child_id, parent_id: purchases whose user's signup came before, at most `within` ago. A stream-stream join; the watermarks and
    the time bound tell how long either side is remembered."""
    timed = lambda s, kind, name: s.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").cast("timestamp").alias(f"{name}_ts")).withWatermark(f"{name}_ts", late)
    c, p = timed(children, "purchase", "child"), timed(parents, "signup", "parent")
    return c.join(p, F.expr(f"child_user = parent_user AND child_ts >= parent_ts AND child_ts <= parent_ts + interval {within}")).select("child_id", "parent_id")


class Control:
    """A projection that can be paused, resumed and drained. Its state is in tables under one folder: a log of controls, the ledger by
    batch, and the stream's checkpoint; so it goes on where it was after any failure."""

    def __init__(self, spark: SparkSession, log: str, can_build: Column, root: str | None = None) -> None:
        self.spark, self.log, self.can_build, self.root = spark, log, can_build, root or folder(spark, "control")

    def _set(self, paused: bool) -> None:
        self.spark.range(1).select(F.lit(paused).alias("paused"), F.expr("unix_micros(current_timestamp())").alias("at")).write.mode("append").parquet(f"{self.root}/controls")

    def pause(self) -> None:
        self._set(True)

    def resume(self) -> None:
        self._set(False)

    @property
    def paused(self) -> bool:
        row = self.spark.read.schema("paused boolean, at long").parquet(f"{self.root}/controls").agg(F.max_by("paused", "at")).first()
        return bool(row[0])

    def run(self) -> tuple[int, int]:
        """Projects what is there, unless paused: (rows projected so far, rows owed that can't be built)."""
        return (0, 0) if self.paused else self.drain()

    def drain(self) -> tuple[int, int]:
        """Projects what is there, paused or not. What can't be built is counted, not tried forever."""
        def write(batch: DataFrame, number: int) -> None:
            batch.where(self.can_build).select("event_id").write.mode("overwrite").parquet(f"{self.root}/ledger/batch={number}")

        owed = F.col("event_type").isin("purchase", "signup")
        stream = events_stream(self.spark, self.log).where(owed)
        stream.writeStream.option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        done = self.spark.read.schema("event_id long").option("recursiveFileLookup", True).parquet(f"{self.root}/ledger")
        left = self.spark.read.parquet(self.log).where(owed).select("event_id").join(done, "event_id", "left_anti")
        return done.count(), left.count()
