"""Dated records behind an item: the span of earliest and latest ones, and their display order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def span(df: DataFrame, group: str, date: str, tie: str, k: int) -> DataFrame:
    """The earliest ceil(k / 2) and latest floor(k / 2) rows of each group by date (null dates first), then ``tie``;
    never more than k."""
    return _ends(df, group, date, tie, (k + 1) // 2, k // 2)


def _ends(df: DataFrame, group: str, date: str, tie: str, first: int, last: int) -> DataFrame:
    """The first and last rows of each group. Each end is its own ranking, so Spark's limit within a partition bounds what
    a task gets of a hot group to ``first`` or ``last`` rows from each other task; a row at both ends counts once (``tie`` tells
    the rows of a group and date apart)."""
    w = Window.partitionBy(group)
    up, down = w.orderBy(F.col(date).asc_nulls_first(), F.col(tie)), w.orderBy(F.col(date).desc_nulls_last(), F.col(tie).desc())
    low = df.withColumn("_at", F.row_number().over(up)).filter(F.col("_at") <= first)
    high = df.withColumn("_at", F.row_number().over(down)).filter(F.col("_at") <= last)
    both = low.withColumn("_end", F.lit(0)).unionByName(high.withColumn("_end", F.lit(1)))
    # within a group of at most first + last rows: those of the low end, then those of the high end that it has not
    again = F.row_number().over(Window.partitionBy(group, date, tie).orderBy("_end", "_at"))
    return both.withColumn("_again", again).filter((F.col("_end") == 0) | (F.col("_again") == 1)).drop("_at", "_end", "_again")


def provenance(links: DataFrame, records: DataFrame, k: int = 8, noise: int = 2000) -> DataFrame:
    """(item, n, noise, record, date, claimed, place) of the records shown for each item.

    links: (item, record, claimed), records: (record, date). n counts all links, also to missing records; noise is more
    than ``noise`` of them. Shown are the span of the claimed records and, in the room left, of the others; claimed
    first, newest first, then record. Only (item, record, date) is ranked; wide columns can be joined to the result.
    """
    counts = links.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    dated = links.join(records, "record").select("item", "record", "claimed", "date")
    claimed = span(dated.filter("claimed"), "item", "date", "record", k)
    taken = claimed.groupBy("item").agg(F.count(F.lit(1)).alias("taken"))
    room = F.lit(k) - F.coalesce("taken", F.lit(0))
    w = Window.partitionBy("item")
    ends = _ends(dated.filter("not claimed"), "item", "date", "record", (k + 1) // 2, k // 2)
    up, down = w.orderBy(F.col("date").asc_nulls_first(), F.col("record")), w.orderBy(F.col("date").desc_nulls_last(), F.col("record").desc())
    others = (
        ends.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).join(taken, "item", "left")
        .filter((F.col("_up") <= F.floor((room + 1) / 2)) | (F.col("_down") <= F.floor(room / 2)))
    )
    shown = claimed.select("item", "record", "claimed", "date").unionByName(others.select("item", "record", "claimed", "date"))
    order = w.orderBy(F.col("claimed").desc(), F.col("date").desc_nulls_last(), "record")
    return shown.join(counts, "item").select("item", "n", (F.col("n") > noise).alias("noise"), "record", "date", "claimed", F.row_number().over(order).alias("place"))


def contiguous_groups(df: DataFrame, group: str, date: str) -> DataFrame:
    """(group, n, first, last) of rows that stream by in the order of their group, with the state of one group at a time.

    Rows are range-partitioned by group and date, so a hot group is cut over several partitions; each partition reports its
    part of a group when the next one begins, and the parts are merged. Null groups are left out; null dates count as rows
    only.
    """
    kind = dict(df.dtypes)[date]
    name = dict(df.dtypes)[group]

    def run(frames):
        key, n, lo, hi = None, 0, None, None
        for frame in frames:
            out = []
            for g, part in frame.groupby("g", sort=False):
                days = part["d"].dropna()
                a, b = (days.min(), days.max()) if len(days) else (None, None)
                if g != key and key is not None:
                    out.append((key, n, lo, hi))
                if g != key:
                    key, n, lo, hi = g, 0, None, None
                n += len(part)
                lo = a if lo is None else lo if a is None else min(lo, a)
                hi = b if hi is None else hi if b is None else max(hi, b)
            yield pd.DataFrame(out, columns=["g", "n", "lo", "hi"])
        if key is not None:
            yield pd.DataFrame([(key, n, lo, hi)], columns=["g", "n", "lo", "hi"])

    rows = df.select(F.col(group).alias("g"), F.col(date).alias("d")).filter("g is not null")
    parts = rows.repartitionByRange("g", "d").sortWithinPartitions("g").mapInPandas(run, f"g {name}, n bigint, lo {kind}, hi {kind}")
    return parts.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"))
