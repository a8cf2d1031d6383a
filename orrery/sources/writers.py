"""Writers: sorted and chunked Parquet, JSON lines, keyed upserts as new versions, and the guarded switch between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.delta import upsert


def sorted_parquet(df: DataFrame, path: str, key: str, partitions: int | None = None, row_group_rows: int | None = None) -> None:
    """Range-partitioned and sorted by key, so that readers can skip row groups by its statistics; files, and with them row
    groups, have at most ``row_group_rows`` rows."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", row_group_rows or 0).option("compression", "zstd").parquet(path)


def chunked_parquet(df: DataFrame, path: str, rows: int) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def json_shards(df: DataFrame, path: str, rows: int = 50_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def tsv(df: DataFrame, path: str, header: bool = True, gzipped: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, compression="gzip" if gzipped else "none")


def upsert_version(spark: SparkSession, current: str, patch: DataFrame, key: list[str], target: str) -> None:
    """A new version at ``target``; the version being read is never written. Applying a patch twice changes nothing."""
    upsert(spark.read.parquet(current), patch, key).write.mode("overwrite").parquet(target)


def switch_view(spark: SparkSession, name: str, path: str, least: int) -> None:
    """Lets ``name`` stand for the version at ``path``; refused if that has fewer than ``least`` rows."""
    t = spark.read.parquet(path)
    n = t.count()
    if n < least:
        raise ValueError(f"{path} has {n} rows, {least} are needed")
    t.createOrReplaceTempView(name)


def reconcile(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: n_in, n_out, n_lost keys and the change of the row count in percent."""
    lost = before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n_lost"))
    a, b = before.agg(F.count(F.lit(1)).alias("n_in")), after.agg(F.count(F.lit(1)).alias("n_out"))
    return a.join(b).join(lost).select("n_in", "n_out", "n_lost", F.round(100.0 * (F.col("n_out") - F.col("n_in")) / F.greatest(F.col("n_in"), F.lit(1)), 4).alias("delta_pct"))


def keyed_chunks(df: DataFrame, path: str, key: str, chunks: int) -> list[int]:
    """One folder ``chunk=<i>`` of Parquet for each part of the keys by hash; a chunk that stands there whole is left as
    it is. Returns the chunks written."""
    fs, folder = _fs(df.sparkSession, path)
    todo = [i for i in range(chunks) if not fs.exists(folder(f"{path}/chunk={i}/_SUCCESS"))]
    for i in todo:
        df.filter(F.pmod(F.xxhash64(key), F.lit(chunks)) == i).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunk={i}")
    return todo


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path
    return folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def wrapped_json(df: DataFrame, path: str, field: str, key: str, rows: int = 100_000) -> None:
    """Files of one object {"field": [row, ...]} each, of about ``rows`` rows, which are gathered to be written: the format
    asks for it, the number of rows bounds it."""
    shards = max(1, -(-df.count() // rows))
    packed = df.groupBy(F.pmod(F.xxhash64(key), F.lit(shards)).alias("_s")).agg(F.collect_list(F.struct(*df.columns)).alias(field))
    packed.select(F.to_json(F.struct(field), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)  # one object a file


def label_maps(df: DataFrame, path: str, key: str, label: str, keys: int = 10_000) -> None:
    """Files of one object {"key": [label, ...]} each, of about ``keys`` keys."""
    lists = df.groupBy(F.col(key).cast("string").alias("_k")).agg(F.array_sort(F.collect_set(label)).alias("_l"))
    shards = max(1, -(-lists.count() // keys))
    packed = lists.groupBy(F.pmod(F.xxhash64("_k"), F.lit(shards)).alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_l"))).alias("m"))
    packed.select(F.to_json("m").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)  # one object a file


def pipe_table(df: DataFrame, path: str) -> None:
    """A pipe-delimited table with a header; fields with line ends or quotes are quoted."""
    df.write.mode("overwrite").csv(path, sep="|", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def copied(spark: SparkSession, source: str, target: str, key: str, parts: int = 4) -> int:
    """A clean copy of a collection in parts by key, which goes on where it was broken off; returns the parts written."""
    return len(keyed_chunks(spark.read.parquet(source), target, key, parts))
