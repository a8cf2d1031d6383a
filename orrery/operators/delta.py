"""Incremental batches: what is new, what replaces what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import free_name


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``done``; rows with a null key are unseen."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def compare_state(df: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of every row: 'new', 'changed' or 'unchanged' against state (key, digest)."""
    old = state.select(key, F.col(digest).alias("_old"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(digest), "changed").otherwise("unchanged")
    return df.join(old, key, "left").select(key, status.alias("status"))


def keep_one(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    place = free_name(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(place) == 1).drop(place)


def upsert(base: DataFrame, patch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the patch replace those of the same key; applying it twice changes nothing more."""
    return base.join(patch.select(*key).distinct(), list(key), "left_anti").unionByName(patch)


def patch_column(base: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """One column taken from the patch where it has a row of the key; all other columns stay."""
    new = patch.select(key, F.col(column).alias("_new"), F.lit(True).alias("_has"))
    return base.join(new, key, "left").withColumn(column, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_has")
