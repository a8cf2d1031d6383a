"""The state of incremental runs: what was done, what is pending, what is gone, and what a run has to do."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.delta import compare_state, upsert


def pick_latest(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row of the greatest version of each key, by a map-side combined maximum; of equal versions, the one with the
    greatest other values in column order, so the result does not depend on the order of the rows."""
    others = [c for c in df.columns if c not in (*key, version)]
    best = df.groupBy(*key).agg(F.max_by(F.struct(version, *others), F.struct(F.col(version), F.xxhash64(*others))).alias("_b"))
    return best.select(*key, "_b.*").select(*df.columns)


def upsert_newer(base: DataFrame, patch: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Of both tables the row of the greatest version of each key: a version that arrives late never replaces a newer
    one, and a patch applied twice changes nothing."""
    return pick_latest(base.unionByName(patch), key, version)


def replace_documents(base: DataFrame, patch: DataFrame, document: str) -> DataFrame:
    """All rows of the documents in the patch are replaced by the patch's rows, also where it has fewer."""
    return upsert(base, patch, [document])


def without_deleted(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tombstone; rows without key stay."""
    return df.join(tombstones.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def add_only(base: DataFrame, more: DataFrame, key: Sequence[str]) -> DataFrame:
    """The base and what is new in ``more``: rows whose key the base has are not added, and nothing is overwritten."""
    return base.unionByName(more.join(base.select(*key).distinct(), list(key), "left_anti").select(*base.columns))


def run_mode(last_run: datetime.date | None, today: datetime.date, has_output: bool, every_days: int = 1) -> str:
    """'fresh' without output or a last run, 'skip' within ``every_days`` of the last run, else 'update'."""
    if last_run is None or not has_output:
        return "fresh"
    return "skip" if (today - last_run).days < every_days else "update"


def run_mode_of(last_run: Column, today: Column, has_output: Column, every_days: int = 1) -> Column:
    """``run_mode`` for every row."""
    fresh = last_run.isNull() | ~F.coalesce(has_output, F.lit(False))
    return F.when(fresh, "fresh").when(F.datediff(today, last_run) < every_days, "skip").otherwise("update")


def with_retry(action: Callable, attempts: int = 5, first_wait: float = 1.0, retry: tuple = (OSError,)):
    """The result of ``action``, tried again after growing waits if one of ``retry`` is raised; the last one is passed on."""
    for i in range(attempts):
        try:
            return action()
        except retry:
            if i + 1 == attempts:
                raise
            time.sleep(first_wait * 2**i)


def commit_after_insert(spark: SparkSession, rows: DataFrame, key: str, digest: str, state: str, insert: Callable[[DataFrame], None]) -> DataFrame:
    """Inserts the rows that are new or changed against the state (key, digest) at ``state`` (v0, v1, ...), and only if
    ``insert`` succeeds makes their digests the next version of the state. The pending digests are written first, so what
    is committed is what was inserted even if the source changes in between. Returns (key, status) of all rows.
    """
    version = _last_version(spark, state)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, `{digest}` {dict(rows.dtypes)[digest]}"
    done = spark.read.parquet(f"{state}/v{version}") if version is not None else spark.createDataFrame([], schema)
    status = compare_state(rows, done, key, digest)
    todo = rows.join(status.filter("status <> 'unchanged'").select(key), key, "left_semi")
    pending = f"{state}/pending"
    todo.select(key, digest).write.mode("overwrite").parquet(pending)
    insert(rows.join(spark.read.parquet(pending), [key, digest], "left_semi"))
    nxt = 0 if version is None else version + 1
    upsert(done, spark.read.parquet(pending), [key]).write.mode("overwrite").parquet(f"{state}/v{nxt}")
    return status


def _last_version(spark: SparkSession, folder: str) -> int | None:
    """The highest n of ``folder``/v<n> that was written to its end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return max(whole, default=None)


def read_through(cache: DataFrame, wanted: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, next cache) of a lookup with a cache (key, status, payload), status 'hit' or 'miss'.

    Keys in the cache are answered from it, misses too; only others are taken from ``fetched`` (key, status, payload),
    where the status 'error' stands for a failure that may pass: it answers nothing and is not remembered, so the key is
    asked again. answers: (key, status, payload) for every different wanted key, status 'error' without an answer.
    """
    asked = wanted.select("key").filter("key is not null").distinct()
    known = asked.join(cache.select("key", "status", "payload"), "key")
    fresh = asked.join(cache.select("key"), "key", "left_anti").join(fetched.select("key", "status", "payload"), "key", "left")
    answers = known.unionByName(fresh.select("key", F.coalesce("status", F.lit("error")).alias("status"), F.when(F.col("status") == "hit", F.col("payload")).alias("payload")))
    return answers, cache.unionByName(fresh.filter("status in ('hit', 'miss')").select("key", "status", F.when(F.col("status") == "hit", F.col("payload")).alias("payload")))


def merge_ledger(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, n_rows, finished_at) with one row a file: the latest entry counts, whichever run wrote it."""
    return upsert_newer(ledger, entries, ["file"], "finished_at")


def process_from(df: DataFrame, key: str, rows: int, state: str, action: Callable[[DataFrame], None]) -> int:
    """Hands ``df`` to ``action`` in batches of ``rows`` rows in the order of the unique, not null ``key``, and notes the last
    key of each batch under ``state`` after its action is done; a run that was broken off goes on behind that key. Returns
    the number of batches of this run. The batch in work when a run broke off is handed over again whole.
    """
    spark, done = df.sparkSession, 0
    while True:
        version = _last_version(spark, state)
        rest = df if version is None else df.filter(F.col(key) > F.lit(spark.read.parquet(f"{state}/v{version}").first()[0]))
        last = rest.select(key).orderBy(key).limit(rows).agg(F.max(key).alias("last"))
        upto = last.first()[0]
        if upto is None:
            return done
        action(rest.filter(F.col(key) <= F.lit(upto)))
        spark.createDataFrame([(upto,)], last.schema).write.mode("overwrite").parquet(f"{state}/v{0 if version is None else version + 1}")
        done += 1
