"""Seeded pseudo-random order and numbers that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed, *cols: Column) -> Column:
    """``md5(seed ':' col ':' ...)``: sorting by it is a seeded shuffle."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head.cast("string"), *[c.cast("string") for c in cols]).cast("binary"))


def unit_hash(*cols: Column) -> Column:
    """Number in [0, 1) taken from the first 32 bits of an md5."""
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
