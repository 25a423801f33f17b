"""Scans: running sums and phase unwrapping, block by block. A block's sum is all that later blocks need of it; sums of
blocks are put together in two levels, so that no task sees more than the sums of BLOCKS blocks, or of all groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sigframe.functions.complexes import is_complex
from sigframe.operators.arrays import scanned
from sigframe.signal import BLOCK, BLOCKS, Signal, block_of


def offsets(sums: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For sums(b, columns) of blocks: the sums of all blocks before each, in columns named _before_."""
    g = sums.withColumn("_g", block_of("b", BLOCKS))
    inside = Window.partitionBy("_g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = g.groupBy("_g").agg(*[F.sum(c).alias(c) for c in columns])
    groups = groups.select("_g", *[F.sum(c).over(across).alias(f"_over_{c}") for c in columns])
    near = g.select("b", "_g", *[F.sum(c).over(inside).alias(f"_near_{c}") for c in columns])
    total = {c: F.coalesce(f"_near_{c}", F.lit(0)) + F.coalesce(f"_over_{c}", F.lit(0)) for c in columns}
    return near.join(groups, "_g").select("b", *[t.alias(f"_before_{c}") for c, t in total.items()])


def _summed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df(idx, b, ..) with the running sums of columns in columns named _sum_."""
    before = offsets(df.groupBy("b").agg(*[F.sum(c).alias(c) for c in columns]), columns)
    upto = Window.partitionBy("b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(before, "b")
    return out.withColumns({f"_sum_{c}": F.col(f"_before_{c}") + F.sum(c).over(upto) for c in columns})


def cumsum(s: Signal, initial: float = 0, block: int = BLOCK) -> Signal:
    """Running sums, plus initial; of arrays entry by entry."""
    s = s.normal()
    if isinstance(s.kind(), ArrayType):
        return scanned(s, lambda samples, _: samples, block, initial=initial)
    if is_complex(s.kind()):
        df = s.df.select("idx", block_of("idx", block).alias("b"), F.col("v")["re"].alias("re"), F.col("v")["im"].alias("im"))
        first = complex(initial)
        out = _summed(df, ("re", "im")).select("idx", F.struct((F.col("_sum_re") + first.real).alias("re"), (F.col("_sum_im") + first.imag).alias("im")).alias("v"))
    else:
        df = s.df.select("idx", block_of("idx", block).alias("b"), "v")
        out = _summed(df, ("v",)).select("idx", (F.col("_sum_v") + F.lit(initial) if initial else F.col("_sum_v")).alias("v"))
    return s.with_df(out)


def _turns(samples: np.ndarray, last: np.ndarray | None) -> np.ndarray:
    """What unwrapping adds to each sample beyond what it has added to the sample before."""
    d = np.diff(samples, axis=0, prepend=samples[:1] if last is None else last[None])
    m = np.mod(d + np.pi, 2 * np.pi) - np.pi
    m[(m == -np.pi) & (d > 0)] = np.pi
    return np.where(np.abs(d) < np.pi, 0.0, m - d)


def unwrap(s: Signal, block: int = BLOCK) -> Signal:
    """Phases with jumps of more than pi replaced by their complements to 2 pi, over the whole signal; of arrays entry by
    entry."""
    s = s.normal()
    if isinstance(s.kind(), ArrayType):
        return scanned(s, _turns, block, real=True, ordered=True, add=True)
    df = s.df.select("idx", F.col("v").cast("double").alias("v"), block_of("idx", block).alias("b"))
    ends = df.groupBy("b").agg(F.max_by("v", "idx").alias("_last")).select((F.col("b") + 1).alias("b"), "_last")
    df = df.join(ends, "b", "left")
    inside = Window.partitionBy("b").orderBy("idx")
    tau, pi = 6.283185307179586, 3.141592653589793
    df = df.withColumn("_d", F.col("v") - F.coalesce(F.lag("v").over(inside), "_last"))
    m = (F.col("_d") + pi) - tau * F.floor((F.col("_d") + pi) / tau) - pi
    df = df.withColumn("_m", m)
    change = F.when(F.col("_d").isNull() | (F.abs("_d") < pi), 0.0).when((F.col("_m") == -pi) & (F.col("_d") > 0), pi - F.col("_d")).otherwise(F.col("_m") - F.col("_d"))
    out = _summed(df.select("idx", "b", "v", change.alias("c")), ("c",))
    return s.with_df(out.select("idx", (F.col("v") + F.col("_sum_c")).alias("v")))
