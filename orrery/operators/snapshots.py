"""What changed between full snapshots: content-defined chunks of the key-sorted releases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _signature(value: Column, kind: T.DataType) -> list[Column]:
    """Columns whose xxhash64 differs whenever the value does: null flags beside every value, as xxhash64 skips nulls."""
    if isinstance(kind, T.StructType):
        return [value.isNull(), *[c for f in kind.fields for c in _signature(value.getField(f.name), f.dataType)]]
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            value = F.transform(value, lambda x: F.xxhash64(*_signature(x, kind.elementType)))
            empty = F.array().cast("array<bigint>")
        else:
            empty = F.array().cast(kind.simpleString())
        members = F.array_sort(F.array_distinct(F.coalesce(value, empty)))
        return [F.size(members), members]
    return [value.isNull(), value]


def row_digest(df: DataFrame, leave_out: Sequence[str]) -> Column:
    """64-bit digest of all other columns: arrays as sets, a null array as an empty one, everything else exactly."""
    parts = [c for f in df.schema.fields if f.name not in leave_out for c in _signature(F.col(f"`{f.name}`"), f.dataType)]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def _unmatched(mask: int, most: int, releases: int):
    """Over rows (k, r, kh, d) sorted by key: cuts chunks after keys whose hash has ``mask`` zero, at most ``most`` keys
    long, and passes on only rows of chunks whose digest differs between releases r - 1 and r."""

    def chunks(frame: pd.DataFrame) -> pd.DataFrame:
        kh, r = frame.kh.to_numpy(), frame.r.to_numpy()
        first = np.ones(len(frame), bool)
        first[1:] = frame.k.to_numpy()[1:] != frame.k.to_numpy()[:-1]
        ordinal = np.cumsum(first) - 1  # of the key
        opens = np.zeros(int(ordinal[-1]) + 1, bool)
        opens[0] = True
        opens[1:] = (kh[first][:-1] & mask) == 0
        start = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
        opens |= (np.arange(len(opens)) - start) % most == 0
        chunk = (np.cumsum(opens) - 1)[ordinal]
        with np.errstate(over="ignore"):
            mixed = (kh.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ frame.d.to_numpy().astype(np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        n = int(chunk[-1]) + 1
        digest, count = np.zeros((n, releases), np.uint64), np.zeros((n, releases), np.int64)
        with np.errstate(over="ignore"):
            np.add.at(digest, (chunk, r), mixed)
        np.add.at(count, (chunk, r), 1)
        none = np.zeros(0, np.int32)
        out = [pd.DataFrame({"k": frame.k.to_numpy()[:0], "step": none, "side": none, "d": frame.d.to_numpy()[:0]})]
        for step in range(1, releases):
            differs = (digest[:, step] != digest[:, step - 1]) | (count[:, step] != count[:, step - 1])
            for side, of in ((0, step - 1), (1, step)):
                hit = differs[chunk] & (r == of)
                out.append(pd.DataFrame({"k": frame.k.to_numpy()[hit], "step": np.full(hit.sum(), step, np.int32), "side": np.full(hit.sum(), side, np.int32), "d": frame.d.to_numpy()[hit]}))
        return pd.concat(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            # all up to the last chunk end; the rest waits, at most `most` keys of it
            k = rest.k.to_numpy()
            last = np.ones(len(rest), bool)
            last[:-1] = k[1:] != k[:-1]
            last[-1] = False  # this key may go on
            ends = np.flatnonzero(last & ((rest.kh.to_numpy() & mask) == 0))
            if not len(ends) and last.sum() > most:
                ends = np.flatnonzero(last)[most - 1 : most]
            if len(ends):
                yield chunks(rest.iloc[: ends[-1] + 1].reset_index(drop=True))
                rest = rest.iloc[ends[-1] + 1 :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield chunks(rest)

    return run


def snapshot_changes(df: DataFrame, key: str, release: str, version: str, chunk_keys: int = 8, most_keys: int = 4096) -> DataFrame:
    """(key, release, change_kind) with change_kind 'added', 'removed' or 'changed' between consecutive releases.

    Every row is reduced to (key, release, 64-bit digest) before any shuffle; of several rows for one key and release
    the one with the latest ``version`` counts (ties: the greater digest). All releases are range-partitioned and sorted
    by key together, so one set of partition limits and content-defined cuts holds for all of them; chunks with equal
    digests are dropped, the rows left are joined by key. Nothing is reported for the first release.

    Rows without key or release are left out; a null version ranks below any other. An empty table, or one release,
    gives no rows. The number of releases (a calendar, not data) is collected to the driver.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(release).isNotNull())
    calendar = sorted(r[0] for r in rows.select(release).distinct().collect())
    number = F.create_map(*[F.lit(x) for i, c in enumerate(calendar) for x in (c, i)]) if calendar else None
    digest = row_digest(df, (key, release, version))
    if number is None:
        return df.select(F.col(key), F.col(release), F.lit(None).cast("string").alias("change_kind")).limit(0)
    narrow = (
        rows.select(F.col(key).alias("k"), number[F.col(release)].alias("r"), F.col(version).alias("v"), digest.alias("d"))
        .groupBy("k", "r")
        .agg(F.max(F.struct("v", "d")).alias("x"))
        .select("k", "r", F.xxhash64("k").alias("kh"), F.col("x.d").alias("d"))
    )
    mask = (1 << max(0, chunk_keys - 1).bit_length()) - 1
    kind = df.schema[key].dataType.simpleString()
    left = (
        narrow.repartitionByRange("k").sortWithinPartitions("k", "r").mapInPandas(_unmatched(mask, most_keys, len(calendar)), f"k {kind}, step int, side int, d bigint")
    )
    joined = left.groupBy("k", "step").agg(F.max(F.when(F.col("side") == 0, F.col("d"))).alias("old"), F.max(F.when(F.col("side") == 1, F.col("d"))).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    name = F.element_at(F.array(*[F.lit(c) for c in calendar]), F.col("step") + 1)
    return joined.select(F.col("k").alias(key), name.alias(release), change.alias("change_kind")).filter("change_kind is not null")
