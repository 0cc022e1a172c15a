"""Seeded randomness as a function of (seed, key), so no result depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits, exact in a double
SPAN = float(16**HEX_DIGITS)


def seeded_md5(seed: int, keys: list[str], tag: str = "") -> Column:
    """md5 of ``seed[:tag]:key...`` as hex text."""
    head = f"{seed}:{tag}" if tag else f"{seed}"
    return F.md5(F.concat_ws(":", F.lit(head), *[F.col(k).cast("string") for k in keys]))


def hash52(seed: int, keys: list[str], tag: str = "", start: int = 1) -> Column:
    """52-bit integer cut from the md5, as a double."""
    digits = F.substring(seeded_md5(seed, keys, tag), start, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double")


def uniform(seed: int, keys: list[str], tag: str = "", start: int = 1) -> Column:
    """Uniform number strictly inside (0, 1)."""
    return (hash52(seed, keys, tag, start) + F.lit(0.5)) / F.lit(SPAN)


def gaussian(seed: int, keys: list[str], tag: str = "") -> Column:
    """Standard normal number by Box-Muller from two halves of one md5."""
    u1 = uniform(seed, keys, tag, 1)
    u2 = uniform(seed, keys, tag, 1 + HEX_DIGITS)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
