"""Per-key results when a few keys hold most records: mergeable histograms instead of gathered groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut

SIGN = np.int64(-(2**63))


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """BIGINTs in the order of the doubles, infinities included; both zeros are one value."""
    b = (v + 0.0).view(np.int64)
    return np.where(b < 0, SIGN - b - 1, b)


def from_ordered_bits(c: np.ndarray) -> np.ndarray:
    return np.where(c < 0, SIGN - c - 1, c).view(np.float64)


def _mapped(df: DataFrame, names: Sequence[str], kind: str, convert) -> DataFrame:
    """``df`` with the columns ``names`` (without nulls) converted batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(convert(x.to_numpy(zero_copy_only=False))) if n in names else x for n, x in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {kind if n in names else k}" for n, k in df.dtypes))


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Column, distinct: bool = False, least: int = 1, bits: int = 12, salts: int = 16) -> DataFrame:
    """(keys, n, rank, value): for every key the values at the wanted ranks, from 1 in ascending order, of a BIGINT.

    ``ranks`` is an ARRAY<BIGINT> made from the column ``n``, the key's number of values; ranks beyond it give no row.
    With ``distinct`` equal values of a key count once. If all ranks are ``least`` or more, keys of fewer rows are dropped
    by a first round of one cell a key. Null keys and values are left out; no rows give an empty result.

    Equal values are counted first, combined before the shuffle and spread by key and value, so that neither a hot key
    nor a hot value is met by one task. Then each key's value range is cut into cells, of which only counts, least and
    greatest value are kept (at most 2 ** bits a key); the cells that hold wanted ranks become the next, narrower ranges,
    until they hold one value. Every key is treated alike. A round meets only the values inside the cells still open,
    through a join that spreads each cell over ``salts`` tasks; there are at most 64 / bits rounds.
    """
    keys = list(keys)
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(x).alias(y) for x, y in zip(keys, k)], F.col(value).cast("bigint").alias("_v")).dropna()
    if least > 1:
        rows = rows.join(rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*k), k, "left_semi")
    counted = rows.groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if distinct:
        counted = counted.withColumn("_c", F.lit(1).cast("bigint"))
    counted = cut(counted)
    low, high = counted.agg(F.min("_v"), F.max("_v")).first()
    left = ((low or 0) ^ (high or 0)).bit_length() if (low or 0) >= 0 or (high or 0) < 0 else 64
    shift = max(0, left - bits)
    cell = F.shiftright("_v", shift)
    cells = counted.groupBy(*k, cell.alias("_cell")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = F.sum("_c").over(Window.partitionBy(*k).orderBy("_cell"))
    total = F.sum("_c").over(Window.partitionBy(*k))
    wanted = cells.withColumn("_upto", upto).withColumn("n", total).withColumn("_r", F.explode(F.array_distinct(ranks)))
    wanted = wanted.filter((F.col("_r") <= F.col("_upto")) & (F.col("_r") > F.col("_upto") - F.col("_c")))
    state = cut(wanted.select(*k, "n", "_r", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_want"), "_cell", "_lo", "_hi"))
    done = []
    while True:
        done.append(state.filter("_lo = _hi").select(*k, "n", "_r", F.col("_lo").alias("_v")))
        if shift == 0 or state.filter("_lo < _hi").isEmpty():
            break
        asked, below = state.filter("_lo < _hi"), shift
        shift = max(0, shift - bits)
        open_cells = asked.select(*k, "_cell").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        inside = counted.withColumn("_cell", F.shiftright("_v", below)).withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int")).join(open_cells, [*k, "_cell", "_salt"])
        parts = inside.groupBy(*k, "_cell", F.shiftright("_v", shift).alias("_part")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_plo"), F.max("_v").alias("_phi"))
        parts = parts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*k, "_cell").orderBy("_part")))
        hit = asked.join(parts, [*k, "_cell"]).filter((F.col("_want") <= F.col("_upto")) & (F.col("_want") > F.col("_upto") - F.col("_c")))
        state = cut(hit.select(*k, "n", "_r", (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_want"), F.col("_part").alias("_cell"), F.col("_plo").alias("_lo"), F.col("_phi").alias("_hi")))
    found = reduce(DataFrame.unionByName, done)
    return found.select(*[F.col(y).alias(x) for x, y in zip(keys, k)], "n", F.col("_r").alias("rank"), F.col("_v").alias("value"))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """(key, n, q0, q1, ...): exact lower quantiles of a number for every key: the value of rank max(1, ceil(p * n)) in
    ascending order, found by ``select_ranks`` over the order-preserving bits of the doubles.

    Null keys, null and NaN values are left out, infinities are values like others; no rows give an empty result.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("k is not null and v is not null and not isnan(v)")
    rank = lambda p: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(float(p)) * F.col("n")))
    found = select_ranks(_mapped(rows, ["v"], "bigint", ordered_bits), ["k"], "v", F.array(*map(rank, probs)))
    per = found.groupBy("k", "n").agg(*[F.max(F.when(F.col("rank") == rank(p), F.col("value"))).alias(f"q{i}") for i, p in enumerate(probs)])
    out = _mapped(per, [f"q{i}" for i in range(len(probs))], "double", from_ordered_bits)
    return out.withColumnRenamed("k", key)
