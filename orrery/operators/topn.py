"""Top N items of every group, with a histogram threshold before the exact ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import free_name


def graded_bin(parts: Sequence[tuple[Column, float, float, int]]) -> Column:
    """A BIGINT that never falls when a row ranks earlier by the scores, all falling: each (score, low, high, cells) is
    cut into equal cells, the first score weighing most. The low end of a cell is refined by the next score; whatever
    lies higher in the cell, or beyond ``high``, gets the cell's last place, and what lies below ``low`` its first. So
    the order holds for all values, and a range that fits the data only makes the bins finer. NaN counts as highest, a
    null score gives a null bin."""
    out, exact, above = F.lit(0).cast("bigint"), F.lit(True), F.lit(False)
    for score, low, high, cells in parts:
        x = (score.cast("double") - low) / (high - low) * cells
        place = F.when(F.isnan(x) | (x >= cells), F.lit(cells - 1)).otherwise(F.greatest(F.floor(x), F.lit(0))).cast("bigint")
        place = F.when(exact, place).when(above, F.lit(cells - 1)).otherwise(F.lit(0))
        out = F.when(score.isNotNull(), out * cells + place)
        edge = place * ((high - low) / cells) + low  # one value only, so rows that are refined are equal so far
        above, exact = above | (exact & (F.isnan(x) | (score > edge))), exact & ~F.isnan(x) & (score == edge)
    return out


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, score_bin: Column, spread: Column, salts: int = 32, rank: str = "rank"
) -> DataFrame:
    """The ``n`` first rows of every group in the total order ``order``, with their rank.

    ``score_bin`` must be non-increasing along ``order``. Counts per (group, bin) give, for every group of more than
    n rows, the highest bin at which at least n rows lie on or above it; rows under it cannot be among the first n and
    are dropped before the ranking shuffle. The thresholds reach the rows by an equi-join on (group, salt), where the
    salt is taken from ``spread`` (any well-spread column of the row), so that a group with a third of all rows is met
    by ``salts`` tasks. Ranking is exact: the partial limit that Spark puts under row_number() bounds what one task
    gets even when a whole group ties in its bin.

    Null groups form no group. Rows with a null bin are ranked last within their group but are kept as candidates.
    An empty input gives an empty result. Repeated rows are ranked as often as they come. A column of the name ``rank``
    is replaced; other extra columns stay, whatever their names.
    """
    bin_, n_, above, floor_, salt = (free_name(df, c) for c in ("bin", "n_rows", "above", "floor", "salt"))
    kept_columns = [c for c in df.columns if c.lower() != rank.lower()]
    rows = df.dropna(subset=list(group)).withColumn(bin_, F.coalesce(score_bin, F.lit(-1).cast("bigint")))
    counts = rows.groupBy(*group, bin_).agg(F.count(F.lit(1)).alias(n_))
    falling = Window.partitionBy(*group).orderBy(F.col(bin_).desc())
    floor = (
        counts.withColumn(above, F.sum(n_).over(falling))
        .filter(F.col(above) >= n)
        .groupBy(*group)
        .agg(F.max(bin_).alias(floor_))
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    survivors = (
        rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .join(floor, [*group, salt], "left")
        .filter(F.col(floor_).isNull() | (F.col(bin_) >= F.col(floor_)))
    )
    place = free_name(df, "place")
    w = Window.partitionBy(*group).orderBy(*order)
    return survivors.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n).select(*kept_columns, F.col(place).alias(rank))


def latest_rows(df: DataFrame, key: Sequence[str], version: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``version`` (ties: the greatest values). Map-side combined, so a key
    delivered very often does not reach one task row by row."""
    best = F.max_by(F.struct(*values), F.struct(version, *values)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{v}").alias(v) for v in values])
