"""Streams of the events table: windows with watermarks, deduplication, state. Each is a plan over a streaming frame;
`drained` runs one over all that is there and returns its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataflow.sources import tables


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; ts as a timestamp, as watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def purchases(events: DataFrame) -> DataFrame:
    """Rows one by one, without state."""
    return events.where("event_type = 'purchase'").select("event_id", "user_id", F.round(F.col("value") * 2, 2).alias("doubled"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with slide the windows overlap."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    return tumbling(events, "2 days", slide="1 day")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user that the watermark has closed."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def with_static(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with columns of a table that stands still; the table is read anew for each batch."""
    return events.join(users, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")


def views_before(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Purchases with the same user's views in the time before, as a join of two streams: watermarks and the bound on the
    times let Spark drop rows that nothing can join any more."""
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought_at")).withWatermark("bought_at", within)
    seen = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("seen_at")).withWatermark("seen_at", within)
    near = (F.col("user_id") == F.col("viewer")) & (F.col("seen_at") <= F.col("bought_at")) & (F.col("seen_at") >= F.col("bought_at") - F.expr(f"INTERVAL {within}"))
    return bought.join(seen, near).select("purchase_id", "view_id")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")


def running_counts(events: DataFrame) -> DataFrame:
    """Events and summed value of each user so far, in state of a fixed size."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


class LargestSoFar(StatefulProcessor):
    """The largest value of each user so far, in a value of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._largest = handle.getValueState("largest", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = max(float(b["value"].max()) for b in rows)
        if self._largest.exists():
            top = max(top, self._largest.get()[0])
        self._largest.update((top,))
        yield pd.DataFrame({"user_id": [key[0]], "largest": [top]})

    def close(self) -> None:
        pass


def largest(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(LargestSoFar(), "user_id long, largest double", "Update", "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, plan: Callable[[DataFrame], DataFrame], sf_dir: str, mode: str, rocksdb: bool = False) -> DataFrame:
    """The rows of a plan over all that is there. In append mode they are as many as the events and never pass the driver:
    tasks write them as Parquet to the shared folder, where they stay. In complete and update mode they are those of groups,
    in the driver's memory; in update mode a key's last row counts. The state's checkpoint is in the shared folder and goes
    when the stream has ended. rocksdb: keep state in that store, as transformWithState asks for; the session's setting comes
    back afterwards."""
    name, setting = f"drained_{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    folder, frame = tables.shared_folder(spark), plan(stream(spark, sf_dir))
    before = spark.conf.get(setting)
    if rocksdb:
        spark.conf.set(setting, ROCKSDB)
    try:
        writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        query = writer.format("parquet").start(f"{folder}/rows") if mode == "append" else writer.format("memory").queryName(name).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
        tables.remove(spark, f"{folder}/checkpoint")
    return tables.read(spark, f"{folder}/rows", frame.schema) if mode == "append" else spark.table(name)
