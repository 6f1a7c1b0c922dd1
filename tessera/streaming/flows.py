"""Structured Streaming flows: windowed counters, sessions, sinks, job state, deduplication, expiry, incremental work.

A flow takes a streaming frame with a TIMESTAMP column `ts` and returns one. drained() runs a flow over what is there and
gives the sink's rows; in service the same flow is started with a trigger instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.upserts import UpsertTable
from tessera.operators.vectors import local_embedding
from tessera.sources.storage import scratch


def rows_():
    return F.count(F.lit(1))


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; event times are read as TIMESTAMP, which watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = reader.parquet(f"{sf_dir}/{name}.parquet*")
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else out


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drained(flow: DataFrame, mode: str, size: int | None = None, rocks: bool = False, progress: list | None = None) -> DataFrame:
    """Runs a flow until its source is exhausted; the sink's rows, with the batch they came in.

    The sink is written by foreachBatch, each batch to a folder of its own number, so that a repeated batch replaces
    itself; in complete mode the last batch is the result. With a size, batches go on in flushes of so many rows. `rocks`
    keeps the state in RocksDB, which state with timers asks for. `progress` gets what Spark reports of each batch.
    """
    spark, path = flow.sparkSession, scratch(flow.sparkSession, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        if size:
            rows = rows.withColumn("flush", F.floor((F.monotonically_increasing_id() % (1 << 33)) / size))
        rows.write.mode("overwrite").parquet(f"{path}/rows/{0 if mode == 'complete' else number}")

    before = spark.conf.get(PROVIDER)
    if rocks:
        spark.conf.set(PROVIDER, ROCKS)
    try:  # the setting is read when the query starts
        query = flow.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    schema = flow.schema.add("batch", "long")
    if size:
        schema = schema.add("flush", "long")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def upserted(flow: DataFrame, table: UpsertTable) -> DataFrame:
    """Merges a flow's batches into a table until its source is exhausted; the table's rows. A repeated batch changes nothing."""
    state = scratch(flow.sparkSession, "stream")
    query = flow.writeStream.foreachBatch(lambda batch, number: table.merge(batch) and None).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.rows()


def minute_counters(events: DataFrame, identity: str, delay: str = "2 minutes") -> DataFrame:
    """(identity, minute, n): tumbling one-minute counters, whose state goes two minutes after their end."""
    return events.withWatermark("ts", delay).groupBy(identity, F.window("ts", "1 minute").alias("w")).agg(rows_().alias("n")).select(identity, F.col("w.start").alias("minute"), "n")


def bursts(events: DataFrame, identity: str, gap: str = "60 seconds") -> DataFrame:
    """(identity, start, n): runs of events no more than a gap apart."""
    return events.withWatermark("ts", "1 hour").groupBy(identity, F.session_window("ts", gap).alias("w")).agg(rows_().alias("n")).select(identity, F.col("w.start").alias("start"), "n")


def hourly_health(events: DataFrame, every: str = "1 hour") -> DataFrame:
    """(start, n, errors): one-hour windows, one every `every`."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", every).alias("w")).agg(rows_().alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("start"), "n", "errors")


#: Job states that an event of a type leads to.
NEXT = {"view": "pending", "click": "processing", "purchase": "completed", "signup": "processing", "error": "failed"}


def job_states(events: DataFrame) -> DataFrame:
    """(job, state, steps): the state of each job after its events so far, and how many there were; kept in Spark's state store."""

    def advance(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last, name, steps = state.get if state.exists else (-1, "pending", 0)
        for frame in frames:
            steps += len(frame)
            newest = frame.loc[frame.event_id.idxmax()]
            if newest.event_id > last:
                last, name = int(newest.event_id), NEXT.get(newest.event_type, name)
        state.update((last, name, steps))
        yield pd.DataFrame({"job": [key[0]], "state": [name], "steps": [steps]})

    rows = events.select(F.col("user_id").alias("job"), "event_id", "event_type")
    return rows.groupBy("job").applyInPandasWithState(advance, "job long, state string, steps long", "last long, name string, steps long", "update", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Events without repeats of the same keys inside the watermark's delay."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


class Expiry(StatefulProcessor):
    """Cache entries that end a time after their last write: one time of expiry for each key, and a timer at it.

    A write at or after an entry's end finds it expired. An entry's end goes out once, when a later write or the
    watermark passes it, and its state goes with it.
    """

    def __init__(self, seconds: int) -> None:
        self.millis = seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "ends long")

    def handleInputRows(self, key, rows, timerValues):
        written = sorted(r["ms"] for r in rows)
        ends = self.ends.get()[0] if self.ends.exists() else None
        if ends is not None:
            self.handle.deleteTimer(ends)
        for at in written:
            if ends is not None and at >= ends:
                yield Row(key=key[0], ended=ends)
            ends = max(ends or 0, at + self.millis)
        self.ends.update((ends,))
        self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield Row(key=key[0], ended=self.ends.get()[0])
        self.ends.clear()

    def close(self) -> None:
        pass


def expired_entries(events: DataFrame, seconds: int, delay: str = "1 hour") -> DataFrame:
    """(key, ended): the end of each cache entry, in milliseconds, as soon as the watermark or a later write passes it."""
    key = F.concat(F.col("event_type"), F.lit(":"), F.col("user_id")).alias("key")
    writes = events.withWatermark("ts", delay).select(key, "ts", F.unix_millis("ts").alias("ms"))
    return writes.groupBy("key").transformWithState(Expiry(seconds), "key string, ended long", "append", "EventTime")


def embedded_rows(rows: DataFrame, dim: int = 8) -> DataFrame:
    """(doc_id, embedding) of rows that have come in since the last run; the source's log keeps what is done."""
    return rows.select("doc_id", local_embedding(F.col("text"), dim).alias("embedding"))
