"""stream_dedup does all rows, and its rows never lie on the driver."""

import subprocess
import sys
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from orrery.plans.library import QUERIES, SQL
from orrery.streaming.incremental import deduplicated, distinct_batches, distinct_rows, events_stream, run_to_memory
from tests.compare import same

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
NEW, OLD = datetime(2024, 1, 1), datetime(1969, 1, 1)
KEYS = [(1, NEW, 1), (1, NEW, 2), (1, datetime(2025, 1, 1), 1), (2, OLD, 3), (3, None, 4), (None, NEW, 5), (None, NEW, 5), (None, None, None)]

SMALL_RESULTS = """
import sys
from orrery.plans.library import QUERIES
from orrery.session import build_session
s = build_session("small", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.driver.maxResultSize": "1m"})
print("ROWS", *QUERIES["stream_dedup"](s, sys.argv[1]).first())
"""


@pytest.fixture
def odd(spark, tmp_path):
    """The table as a folder of files, with an event of two users, one of before 1970, and missing values."""
    spark.createDataFrame([(*k, "view", 1.0, "{}") for k in KEYS], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    return tmp_path


@pytest.mark.parametrize("n", [0, len(KEYS)])
def test_dedup_counts_as_sql_does(spark, odd, n):
    (odd / "file").mkdir()
    duckdb.sql(f"copy (from '{odd}/folder/events.parquet/*.parquet' limit {n}) to '{odd}/file/events.parquet' (format parquet)")
    same(spark, f"{odd}/file", QUERIES["stream_dedup"], SQL["stream_dedup"])


def test_dedup_reads_a_folder_of_files(spark, odd):
    assert QUERIES["stream_dedup"](spark, f"{odd}/folder").collect() == [(6, 5)]


def test_dedup_holds_across_batches_and_runs(spark, tmp_path):
    """Equal rows come in several batches, long after each other; a second run adds only what is new."""
    for run in range(2):
        for i in range(3):
            spark.createDataFrame([*KEYS, (100 * run + i, NEW, 9)], "event_id bigint, ts timestamp_ntz, user_id bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        pairs = spark.readStream.schema("event_id bigint, user_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        distinct_batches(pairs, f"{tmp_path}/rows", f"{tmp_path}/state").awaitTermination()
    rows = distinct_rows(spark, f"{tmp_path}/rows", pairs.schema).collect()
    want = {(e, u) for e, _, u in KEYS} | {(100 * run + i, 9) for run in range(2) for i in range(3)}
    assert len(list(tmp_path.glob("rows/_batch=*"))) == 6
    assert Counter(map(tuple, rows)) == Counter(want)


def test_bounded_dedup_gives_up_what_a_watermark_must(spark, odd):
    rows = run_to_memory(deduplicated(events_stream(spark, f"{odd}/folder"), late="60 days").select("event_id"), "bounded", "append").collect()
    assert sorted(rows, key=str) == [(1,), (3,), (None,)]


def test_dedup_sends_no_rows_to_the_driver(spark, tmp_path):
    """200 000 rows are several MB, more than the results that this driver takes in."""
    rows = spark.range(200_000).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "id % 1000 as user_id", "'view' as event_type", "1d as value", "'{}' as props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/all")
    (tmp_path / "in").mkdir()
    next((tmp_path / "all").glob("part-*.parquet")).rename(tmp_path / "in/events.parquet")
    run = subprocess.run([sys.executable, "-c", SMALL_RESULTS, f"{tmp_path}/in"], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parent.parent)
    assert "ROWS 200000 1000" in run.stdout, run.stderr[-2000:]
