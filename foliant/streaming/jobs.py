"""Streaming jobs: running a stream to its end, snapshots kept by foreachBatch."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.members import last_verdict
from foliant.operators.sync import last_wins
from foliant.sources.files import scratch_dir
from foliant.streaming.stateful import ORIGIN

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 64) -> DataFrame:
    """A table's files as a stream; at most ``max_files`` enter one micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    files = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files)
    if [f.rsplit("/", 1)[1] for f in table.inputFiles()] == [f"{name}.parquet"]:
        # A lone file has no folder of its own that a stream could watch.
        return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return files.parquet(path)


END_US = 8_800_000_000_000_000  # in the year 2248; time stamps in frames end in 2262


def with_closing(stream: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``stream`` with a column closing, and a function that lands one row at the end of time.

    The row has nothing but its time; it lets the watermark pass all rows of a finished table.
    """
    spark = stream.sparkSession
    place = scratch_dir(spark, "closing")
    spark.createDataFrame([], "us long").write.parquet(place)  # the folder, for the stream to watch
    bell = spark.readStream.schema("us long").parquet(place).select(*[
        F.col("us") if f.name == "us" else F.lit(None).cast(f.dataType).alias(f.name)
        for f in stream.schema], F.lit(True).alias("closing"))

    def ring() -> None:
        spark.createDataFrame([(END_US,)], "us long").coalesce(1).write.mode("append").parquet(
            place)

    return stream.withColumn("closing", F.lit(False)).unionByName(bell), ring


def late_rows(progress: Sequence[dict]) -> int:
    """Rows dropped for being later than the watermark, over the progress reports of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def run_to_end(stream: DataFrame, mode: str = "append", ring: Callable[[], None] | None = None,
               late: list[int] | None = None) -> DataFrame:
    """Process everything available, then read the written result.

    With ``ring``, of ``with_closing``, the stream is then closed and run on from its checkpoint,
    so that rows which wait for the watermark come out.  The number of rows dropped for being late
    is appended to ``late``.  A deployment keeps the query running with
    ``trigger(processingTime=…)`` instead.
    """
    spark = stream.sparkSession
    out, state = scratch_dir(spark, "stream"), scratch_dir(spark, "stream-state")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for _ in range(2 if ring else 1):
            running = stream.writeStream.format("parquet").outputMode(mode).option(
                "checkpointLocation", state).option("path", out).trigger(
                availableNow=True).start()
            running.awaitTermination()
            if late is not None:
                late.append(late_rows([json.loads(p.json) for p in running.recentProgress]))
            if ring:
                ring()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(out)


def once_each(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """``stream`` (us, ...) without rows redelivered within ``delay``, by ``keys``."""
    at = F.timestamp_micros(F.col("us") + ORIGIN)
    return stream.withColumn("at", at).withWatermark("at", delay).dropDuplicatesWithinWatermark(
        list(keys)).drop("at")


def run_snapshots(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]
                  ) -> DataFrame:
    """Fold each micro-batch into a snapshot table.

    Every batch writes version ``batch+1`` from version ``batch``, so a replayed batch
    overwrites its own version and nothing counts twice.
    """
    spark = stream.sparkSession
    base, state = scratch_dir(spark, "snapshot"), scratch_dir(spark, "snapshot-state")
    versions: list[int] = []

    def fold(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        earlier = [v for v in versions if v <= batch_id]
        current = s.read.parquet(f"{base}/v{max(earlier)}") if earlier else None
        merge(current, batch).write.mode("overwrite").parquet(f"{base}/v{batch_id + 1}")
        if batch_id + 1 not in versions:
            versions.append(batch_id + 1)

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", state).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/v{max(versions)}")


def merge_activity(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Activity ledger after a batch: counts added, first and last seen widened."""
    fresh = batch.groupBy("user_id").agg(
        F.count("*").alias("msg_count"), F.min("us").alias("first_seen"),
        F.max("us").alias("last_seen"))
    if current is None:
        return fresh
    return current.unionByName(fresh).groupBy("user_id").agg(
        F.sum("msg_count").alias("msg_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))


def merge_feedback(keys: Sequence[str]):
    """Feedback table after a batch: the newest verdict of a key replaces the one before."""
    def merge(current, batch):
        fresh = last_verdict(batch, list(keys))
        return fresh if current is None else last_wins([current, fresh], list(keys))
    return merge
