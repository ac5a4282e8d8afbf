"""Seeded draws as column expressions: the same keys give the same number on every run and layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform in (0, 1): the upper 52 bits of a hash of the seed and the keys."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12) + 0.5) / F.lit(float(1 << 52))


def seeded_order(seed: int, *keys: Column | str) -> Column:
    """A number to order by: md5 of seed and keys, which SQL engines agree on."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))
