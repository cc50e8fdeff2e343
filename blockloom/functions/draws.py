"""Pseudo-random draws as hashes of stable keys.

The same key always gives the same draw, so results do not depend on partitioning, retries or cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: hex digits taken from the md5 digest; 13 digits are 52 bits, exact in a double.
DRAW_DIGITS = 13


def draw_hex(seed: int, *keys: Column) -> Column:
    """md5 of ``seed:key:key…``, a total order for a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def draw_long(seed: int, *keys: Column) -> Column:
    """Uniform integer in [0, 2^52)."""
    return F.conv(F.substring(draw_hex(seed, *keys), 1, DRAW_DIGITS), 16, 10).cast("long")


def draw_below(bound: Column, seed: int, *keys: Column) -> Column:
    """Uniform integer in [0, bound)."""
    return F.pmod(draw_long(seed, *keys), bound)


def draw_unit(seed: int, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return draw_long(seed, *keys).cast("double") / F.lit(float(1 << (4 * DRAW_DIGITS)))
