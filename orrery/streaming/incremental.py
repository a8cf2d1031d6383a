"""Structured Streaming forms of the incremental batches: deduplication, event windows, and upserts per micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.state import pick_latest, upsert_newer
from orrery.session import ensure_checkpoint_dir


def event_windows(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window and event type; rows later than ``late`` are given up."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, with state bounded by the watermark; rows later than ``late`` and those of before 1970, where a
    watermark begins, are given up."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def distinct_batches(stream: DataFrame, base: str, checkpoint: str):
    """Runs the available input once; each micro-batch adds to the store under ``base`` those of its rows that no batch
    before has brought, each once, however late they are; a repeated batch changes nothing. What is known lies in files,
    which executors write and every batch reads, so that it may outgrow the memory of executors and driver.
    ``distinct_rows`` reads the store, which keeps one checkpoint for life.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        held = _written(spark, base, number)
        new = batch.subtract(spark.read.schema(batch.schema).parquet(*held)) if held else batch.distinct()
        new.write.mode("overwrite").parquet(f"{base}/_batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_rows(spark: SparkSession, base: str, schema) -> DataFrame:
    """The store that ``distinct_batches`` keeps."""
    held = _written(spark, base)
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def upsert_batches(stream: DataFrame, key: str, version: str, base: str, checkpoint: str, buckets: int = 64):
    """Runs the available input once; each micro-batch adds to the store under ``base``, in which the row of the greatest
    version of each key counts, whichever batch brings it: an older version that arrives late replaces nothing, and a
    repeated batch changes nothing. ``current_rows`` reads the store.

    The store is cut into ``buckets`` by the key; a batch writes new versions of only those buckets that it touches, each
    bucket's folder bearing the number of the batch, so that what readers see is never overwritten. Numbers belong to the
    checkpoint: a store keeps one and the same for life.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        patch = pick_latest(batch, [key], version).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in patch.select("_bucket").distinct().collect()]  # at most ``buckets``
        held = _bucket_paths(spark, base, number)
        old = [held[b] for b in touched if b in held]
        if old:
            before = spark.read.option("basePath", base).parquet(*old).drop("_batch").select(*patch.columns)
            patch = upsert_newer(before, patch, [key, "_bucket"], version)
        patch.write.mode("overwrite").partitionBy("_bucket").parquet(f"{base}/_batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, base: str, before: int | None = None) -> list[str]:
    """The folders that batches of a number less than ``before`` have written whole, in the order of their numbers."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path
    fs = folder(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder(base)):
        return []
    batches = sorted(int(x.getPath().getName().removeprefix("_batch=")) for x in fs.listStatus(folder(base)) if x.getPath().getName().startswith("_batch="))
    return [f"{base}/_batch={n}" for n in batches if (before is None or n < before) and fs.exists(folder(f"{base}/_batch={n}/_SUCCESS"))]


def _bucket_paths(spark: SparkSession, base: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each bucket, written whole by a batch of a number less than ``before``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = folder(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for path in _written(spark, base, before):
        for x in fs.listStatus(folder(path)):
            if x.getPath().getName().startswith("_bucket="):
                out[int(x.getPath().getName().removeprefix("_bucket="))] = f"{path}/{x.getPath().getName()}"
    return out


def current_rows(spark: SparkSession, base: str) -> DataFrame:
    """The store that ``upsert_batches`` keeps, one row a key."""
    return spark.read.option("basePath", base).parquet(*_bucket_paths(spark, base).values()).drop("_batch", "_bucket")


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drives a stream over all available input into a memory table of that name. The driver holds its rows: for results
    that do not grow with the input."""
    ensure_checkpoint_dir(df.sparkSession)
    shared = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    state = f"{shared}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream, be it one file or a folder of files: as a glob the path may be either."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
