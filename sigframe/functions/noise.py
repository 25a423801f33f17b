"""White noise that depends on a seed and a position only, not on how rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(idx: Column, seed: int, stream: int) -> Column:
    """In (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.lit(stream).cast("long"), idx.cast("long")), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def normal(idx: Column, seed: int) -> Column:
    """Standard normal values by Box and Muller's transform."""
    return F.sqrt(-2.0 * F.log(uniform(idx, seed, 0))) * F.cos(2.0 * F.pi() * uniform(idx, seed, 1))
