"""Structured Streaming over an event journal. Each function drains what is there (``availableNow``)
into a table in the shared folder and returns that table's current state; a restart with the same
folder goes on from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessella.plans.materialise import shared_dir
from tessella.streaming.machines import FailHook, JobPhases, Phase, Rotation, Settle


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files at ``path``, a folder or one file; the pattern lets it be either."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that begin within keep their state in RocksDB, which stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _drained(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """The rows that the stream emits, through a Parquet sink with exactly-once commits. A folder
    ``at`` that an earlier run used goes on from where that ended."""
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    schema = stream.schema
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def _machine(rows: DataFrame, key: str, machine: StatefulProcessor, name: str, at: str | None, time: str = "none") -> DataFrame:
    """All rows that a state machine emits over a stream, one machine per key."""
    with _state_in_rocksdb(rows.sparkSession):
        return _drained(rows.groupBy(key).transformWithState(machine, machine.OUTPUT, "append", time), name, at=at)


def _last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def job_phases(events: DataFrame, phases: list[tuple[str, Phase]], fail_hook: FailHook | None = None, at: str | None = None) -> DataFrame:
    """The current state of each job (column ``job``) after its commands; see ``JobPhases``."""
    return _last(_machine(events, "job", JobPhases(phases, fail_hook), "jobs", at), "job", "event_id")


def settled(snapshots: DataFrame, calls: int, timeout: int, delay: str, at: str | None = None) -> DataFrame:
    """Each path with when it was queued, repeats and timeouts; see ``Settle``. Timers follow the
    event time in ``ts``, which may be late by ``delay``."""
    return _last(_machine(snapshots.withWatermark("ts", delay), "path", Settle(calls, timeout), "settle", at, "eventTime"), "path", "seen", "timeouts")


def rotated(ticks: DataFrame, interval: int, at: str | None = None) -> DataFrame:
    """One row per tick of each playlist (column ``playlist``); see ``Rotation``."""
    return _machine(ticks, "playlist", Rotation(interval), "rotation", at)


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """Each (user, type) once, however often it arrives: an idempotent enqueue."""
    keyed = events(spark, path).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return _drained(keyed, "first-seen").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


STATE = "attempts long, errors long, last long, state string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job's state machine: attempts, errors and the state that the last event left."""
    attempts, errors, last, now = state.get if state.exists else (0, 0, -1, "queued")
    for pdf in batches:
        attempts += len(pdf)
        errors += int((pdf["event_type"] == "error").sum())
        at = int(pdf["event_id"].idxmax())
        if pdf["event_id"][at] > last:
            last, now = int(pdf["event_id"][at]), pdf["event_type"][at]
    state.update((attempts, errors, last, now))
    yield pd.DataFrame({"user_id": [key[0]], "attempts": [attempts], "errors": [errors], "last": [last], "state": [now]})


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """The current state of each job after its events; every update is appended, the last counts."""
    keyed = events(spark, path).select("user_id", "event_id", "event_type").groupBy("user_id")
    updates = keyed.applyInPandasWithState(_advance, "user_id long, " + STATE, STATE, "append", GroupStateTimeout.NoTimeout)
    newest = _drained(updates, "job-states").groupBy("user_id").agg(F.max_by(F.struct("attempts", "errors", "state"), F.struct("last", "attempts")).alias("s"))
    return newest.select("user_id", "s.attempts", "s.errors", "s.state")


def window_counts(spark: SparkSession, path: str) -> DataFrame:
    """Events per six hours and type, late ones within a day included. A last event far in the
    future is not at hand, so windows are emitted as they change and the last count stands."""
    stamped = events(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counted = stamped.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    at = f"{shared_dir(spark)}/tessella/windows-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), "event_type", "n").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
