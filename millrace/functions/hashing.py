"""Seeded numbers that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(*parts: Column | str | int) -> Column:
    """60-bit integer from the parts joined by colons."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    joined = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def seeded_uniform(*parts: Column | str | int) -> Column:
    """Number in [0, 1)."""
    return seeded_hash(*parts).cast("double") / F.lit(float(2 ** HASH_BITS))


def text_signature(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws("", *parts), 256), 1, 16)
