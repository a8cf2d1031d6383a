"""Filters written as plain values: {field: value}, {field: [values]} or {field: {"gte": x, "lte": y}}, all of which must hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compile_filter(df: DataFrame, wanted: dict | None) -> Column:
    """On an array field a value means contains, a list means overlaps. An unknown field raises ValueError."""
    parts = [F.lit(True)]
    for field, value in (wanted or {}).items():
        if field not in df.columns:
            raise ValueError(f"unknown field {field}")
        c, many = F.col(field), isinstance(df.schema[field].dataType, T.ArrayType)
        if isinstance(value, dict):
            unknown = set(value) - {"gte", "lte", "gt", "lt"}
            if unknown:
                raise ValueError(f"unknown range ends {sorted(unknown)}")
            ops = {"gte": c.__ge__, "lte": c.__le__, "gt": c.__gt__, "lt": c.__lt__}
            parts += [ops[k](v) for k, v in value.items()]
        elif isinstance(value, (list, tuple, set)):
            parts.append(F.arrays_overlap(c, F.array(*map(F.lit, value))) if many else c.isin(list(value)))
        else:
            parts.append(F.array_contains(c, value) if many else c == F.lit(value))
    return reduce(lambda a, b: a & b, parts)
