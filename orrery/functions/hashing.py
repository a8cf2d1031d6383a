"""Stable ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_id(key: Column) -> Column:
    """63-bit id of a string: the leading 8 bytes of its SHA-256 without the sign bit."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, -10).cast("bigint").bitwiseAND(F.lit(9223372036854775807).cast("bigint"))


def content_hash(**fields: Column) -> Column:
    """SHA-256 over 'name:value' joined by '|', in the order given; a null value stands as ''."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}:"), F.coalesce(c.cast("string"), F.lit(""))) for n, c in fields.items()]), 256)


def hash_order(seed: int, key: Column) -> Column:
    """A reproducible shuffle order."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))
