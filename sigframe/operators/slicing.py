"""Positions: slices, heads, ends, reversal, splits, zips. All of these are projections and filters; a range of
positions reaches the scan, where row groups outside of it are skipped."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.signal import Signal, block_of, signal


def _count(n: int, name: str) -> int:
    if n < 0:
        raise ValueError(f"{name} must not be negative")
    return int(n)


def sliceiter(spark: SparkSession, n: int, stop: int) -> DataFrame:
    """Slices (start, stop) of n positions up to stop; the last may be shorter."""
    if n < 1:
        raise ValueError("n must be positive")
    return spark.range(0, _count(stop, "stop"), n).select(F.col("id").alias("start"), F.least(F.col("id") + n, F.lit(stop)).alias("stop"))


def linspace(spark: SparkSession, start: float, stop: float, points: int, endpoint: bool = True) -> Signal:
    """Evenly spaced numbers, each computed from its position. One point is start."""
    steps = points - 1 if endpoint else points
    step = (float(stop) - float(start)) / steps if steps > 0 else 0.0
    return signal(spark.range(_count(points, "points")).select(F.col("id").alias("idx"), (F.lit(float(start)) + F.col("id") * F.lit(step)).alias("v")))


def mapped(s: Signal, *columns: Column, names: Sequence[str] | None = None) -> Signal:
    """A stateless map: new value columns from expressions."""
    named = tuple(names or (s.values if len(columns) == len(s.values) else [f"v{i}" for i in range(len(columns))]))
    return s.with_df(s.df.select(s.idx, *[c.alias(n) for c, n in zip(columns, named)]), values=named)


def enumerate(s: Signal, start: int = 0) -> Signal:
    """Positions as a value beside the others."""
    return s.with_df(s.df.withColumn("n", F.col(s.idx) + start), values=("n", *s.values))


def stop_after(s: Signal, n: int) -> Signal:
    return s.with_df(s.df.where(F.col(s.idx) < _count(n, "n")))


def start_after(s: Signal, n: int) -> Signal:
    """Without the first n samples; positions start at 0 again."""
    return s.with_df(s.df.where(F.col(s.idx) >= _count(n, "n")).withColumn(s.idx, F.col(s.idx) - n))


def head(s: Signal, n: int) -> tuple[Signal, Signal]:
    """The first n samples, and the whole signal again."""
    return stop_after(s, n), s


def peek(s: Signal, chunk_size: int, chunks: int = 1) -> tuple[Signal, Signal]:
    """The first chunks, and the whole signal again."""
    return stop_after(s, chunk_size * chunks), s


def reverse(s: Signal, n: int | None = None) -> Signal:
    """Last sample first. n is the length, where it is known."""
    n = s.length() if n is None else n
    return s.with_df(s.df.withColumn(s.idx, F.lit(n - 1) - F.col(s.idx)))


def split(s: Signal) -> tuple[Signal, ...]:
    """A signal for each value column; a scan reads only the columns of those that are used."""
    return tuple(s.with_df(s.df.select(s.idx, c), values=(c,)) for c in s.values)


def zipped(*signals: Signal) -> Signal:
    """Value columns side by side, as long as the shortest signal."""
    parts = [x.normal() for x in signals]
    df, names = parts[0].df, []
    columns = [F.col("idx")]
    for i, p in zip(range(len(parts)), parts):
        renamed = p.df.select(F.col("idx").alias(f"idx{i}"), *[F.col(c).alias(f"s{i}_{c}") for c in p.values])
        df = renamed.withColumnRenamed("idx0", "idx") if i == 0 else df.join(renamed, F.col("idx") == F.col(f"idx{i}"))
        for c in p.values:
            names.append(f"v{len(names)}")
            columns.append(F.col(f"s{i}_{c}").alias(names[-1]))
    return signals[0].with_df(df.select(*columns), idx="idx", values=tuple(names))


def tee(s: Signal, n: int = 2, keep: bool = False) -> tuple[Signal, ...]:
    """n handles of one signal. They are independent: none waits for another. keep holds the samples for all of them."""
    kept = reusable(s) if keep else s
    return (kept,) * n


def reusable(s: Signal) -> Signal:
    """The signal held in memory and on disk, for several passes over a costly plan."""
    return s.with_df(s.df.persist(StorageLevel.MEMORY_AND_DISK))


def chunked(s: Signal, chunk_size: int, skip: int = 1) -> DataFrame:
    """idx, chunk and values; only chunks with a number that skip divides."""
    df = s.df.withColumn("chunk", block_of(s.idx, chunk_size))
    return df.where(F.col("chunk") % skip == 0) if skip > 1 else df


def concatenate(s: Signal) -> np.ndarray | tuple[np.ndarray, ...]:
    """All samples in order on the driver: for results known to be small."""
    from sigframe.functions.complexes import is_complex

    rows = s.df.select(s.idx, *s.values).orderBy(s.idx).toArrow()
    out = []
    for c in s.values:
        if is_complex(s.kind(c)):
            flat = rows.column(c).combine_chunks()
            out.append(flat.field("re").to_numpy(zero_copy_only=False) + 1j * flat.field("im").to_numpy(zero_copy_only=False))
        else:
            out.append(np.array(rows.column(c).to_pylist()))
    return out[0] if len(out) == 1 else tuple(out)
