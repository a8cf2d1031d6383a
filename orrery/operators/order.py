"""Running numbers and ordered lists without duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut, free_name


def running_number(df: DataFrame, order: Sequence[str], name: str = "number", first: int = 0) -> DataFrame:
    """``df`` with its rows numbered in ``order`` (names of columns whose values together are unique).

    Rows are range-partitioned and numbered within their partition; what the partitions before hold is added, so no task
    sees more than one partition. Nulls come first; an empty table stays empty; a column ``name`` is replaced.
    """
    part, before = free_name(df, "part"), free_name(df, "before")
    ranged = cut(df.drop(name).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(before))  # one row a partition
    offsets = sizes.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + local - 1 + first).drop(part, before)


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before and with each one, in the same two steps."""
    part, before = free_name(df, "part"), free_name(df, "before")
    ranged = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(F.sum(value).alias(before))  # one row a partition
    offsets = sums.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    local = F.sum(value).over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(offsets), part).withColumn(name, F.coalesce(F.col(before), F.lit(0)) + local).drop(part, before)


def first_occurrences(df: DataFrame, group: str, item: Column, rank: str, most: int | None = None) -> DataFrame:
    """(group, item, rank): each item once, where it first occurs, ranked anew from 1; the first ``most`` ones. Null items
    are left out."""
    once = df.select(group, item.alias("item"), F.col(rank).alias("_at")).filter("item is not null").groupBy(group, "item").agg(F.min("_at").alias("_at"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_at", "item")).cast("bigint")).drop("_at")
    return ranked if most is None else ranked.filter(F.col("rank") <= most)
