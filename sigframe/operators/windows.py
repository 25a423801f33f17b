"""Chunks with overlap, sliding windows, and averages of batches, from closed forms of which rows a chunk covers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sigframe.functions.complexes import is_complex, scaled
from sigframe.operators.arrays import batch_means
from sigframe.signal import Signal, block_of


#: Positions of a block that windows are cut from, unless windows are long.
SPAN = 1 << 12


def pre_rechunk(s: Signal, chunk_size: int, overlap_size: int = 0, yield_remainder: bool = True, n: int | None = None) -> DataFrame:
    """chunk, idx and values: each row once for each chunk that covers it, and none for gaps (a negative overlap).

    Chunk k covers [k*hop, k*hop + chunk_size), hop = chunk_size - overlap_size. After the full ones comes one partial
    chunk where rows are left from its start on, overlap rows included.
    """
    if chunk_size <= overlap_size:
        raise ValueError("overlap_size must be smaller than chunk_size")
    c, hop = int(chunk_size), int(chunk_size - overlap_size)
    n = s.length() if n is None else n
    full = (n - c) // hop + 1 if n >= c else 0
    last = full if yield_remainder and full * hop < n else full - 1
    if overlap_size == 0:
        df = s.df.withColumn("chunk", block_of(s.idx, c))
        return df.where(F.col("chunk") <= last).select("chunk", s.idx, *s.values)
    i = f"`{s.idx}`"
    low = f"greatest(0L, ceil(cast({i} - {c - 1} as double) / {hop}))" if n < 1 << 50 else f"greatest(0L, ({i} - {c} + {hop}) div {hop})"
    high = f"least({last}L, {i} div {hop})"
    df = s.df.withColumns({"_lo": F.expr(low), "_hi": F.expr(high)}).where("_lo <= _hi")
    return df.withColumn("chunk", F.explode(F.sequence("_lo", "_hi"))).select("chunk", s.idx, *s.values)


def _gathered(df: DataFrame, key: str, idx: str, values: Sequence[str]) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(idx, *values)))
    df = df.groupBy(key).agg(rows.alias("_r"))
    return df.select(key, F.size("_r").cast("long").alias("actual_size"), *[F.col(f"_r.{v}").alias(v) for v in values])


def rechunk(s: Signal, chunk_size: int, overlap_size: int = 0, padding: bool = False, yield_remainder: bool = True, n: int | None = None, concatenate: Callable[[Column], Column] | None = None) -> DataFrame:
    """chunk, actual_size and an array for each value column; with padding, arrays are filled with zeros to chunk_size.
    concatenate makes something else of a chunk's array of samples (with what padding adds), as an expression."""
    out = _gathered(pre_rechunk(s, chunk_size, overlap_size, yield_remainder, n), "chunk", s.idx, s.values)
    out = _padded(out, s, chunk_size) if padding else out
    return out.withColumns({v: concatenate(F.col(v)) for v in s.values}) if concatenate else out


def _padded(df: DataFrame, s: Signal, size: int) -> DataFrame:
    def zero(kind, like):
        """Nothing, in the shape of a sample that there is."""
        if isinstance(kind, ArrayType):
            return F.transform(like, lambda x: zero(kind.elementType, x))
        return F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")).cast(kind) if is_complex(kind) else F.lit(0).cast(kind)

    return df.withColumns({v: F.concat(v, F.array_repeat(zero(s.kind(v), F.col(v)[0]), (F.lit(size) - F.size(v)).cast("int"))) for v in s.values})


def combine_chunks(chunks: DataFrame, factor: int, values: Sequence[str] = ("v",)) -> DataFrame:
    """Each `factor` successive chunks (chunk, actual_size, arrays) as one."""
    if factor < 1:
        raise ValueError("factor must be positive")
    rows = F.sort_array(F.collect_list(F.struct("chunk", "actual_size", *values)))
    df = chunks.groupBy(block_of("chunk", factor).alias("_c")).agg(rows.alias("_r"))
    return df.select(F.col("_c").alias("chunk"), F.expr("aggregate(_r.actual_size, 0L, (a, x) -> a + x)").alias("actual_size"), *[F.flatten(f"_r.{v}").alias(v) for v in values])


def _apart(df: DataFrame, w: int, step: int) -> DataFrame:
    """window and v where windows do not overlap: each row goes to the one window that it is in, or nowhere."""
    df = df.where(F.col("idx") % step < w).withColumn("window", block_of("idx", step))
    return df.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("_r")).select("window", F.col("_r.v").alias("v"))


def _overlapping(df: DataFrame, w: int, step: int, count: int) -> DataFrame:
    """window and v where they do: blocks of positions, each with the w - 1 that follow it, are cut into the windows that
    begin in them. So a row is shuffled about once, however many windows it is in."""
    size = max(SPAN, 4 * w)
    own = block_of("idx", size)
    two = (F.col("idx") % size < w - 1) & (own > 0)
    held = df.withColumn("_b", F.explode(F.when(two, F.array(own, own - 1)).otherwise(F.array(own))))
    held = held.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("_r")).select("_b", F.col("_r.v").alias("_a"))
    first, last = F.expr(f"(_b * {size} + {step - 1}) div {step}"), F.expr(f"least({count - 1}L, ((_b + 1) * {size} - 1) div {step})")
    held = held.withColumns({"_k": first, "_z": last}).where("_k <= _z").withColumn("window", F.explode(F.sequence("_k", "_z")))
    return held.select("window", F.expr(f"slice(_a, cast(window * {step} - _b * {size} + 1 as int), {w})").alias("v"))


def sliding_window(s: Signal, window: int | Sequence[float], step: int, output_chunksize: int | str | None = None, padding: bool = False, yield_remainder: bool = True, n: int | None = None) -> DataFrame:
    """Whole windows of a signal: window k holds the rows [k*step, k*step + w), times coefficients where these are given.

    With output_chunksize, the windows in batches: batch, actual_size, windows (with padding, windows of zeros fill the
    last one); "auto" makes batches of near one MiB. There are no partial windows.
    """
    coefficients = None if isinstance(window, int) else [float(x) for x in window]
    w = window if coefficients is None else len(coefficients)
    if output_chunksize == "auto":
        width = 16 if is_complex(s.kind()) else {"float": 4, "int": 4, "smallint": 2, "tinyint": 1}.get(s.kind().simpleString(), 8)
        output_chunksize = max(1, (1 << 20) // (max(w, 1) * width))
    if w < 1 or step < 1 or output_chunksize is not None and output_chunksize < 1:
        raise ValueError("window, step and output_chunksize must be positive")
    n = s.length() if n is None else n
    count = (n - w) // step + 1 if n >= w else 0
    df = s.df.select(F.col(s.idx).cast("long").alias("idx"), F.col(s.value).alias("v")).where(F.col("idx") < (count - 1) * step + w)
    out = _overlapping(df, w, step, count) if step < w else _apart(df, w, step)
    if coefficients is not None:
        by = F.array(*map(F.lit, coefficients))
        times = (lambda x, i: scaled(x, by[i])) if is_complex(s.kind()) else (lambda x, i: x * by[i])
        out = out.withColumn("v", F.transform("v", times))
    if output_chunksize is None:
        return out
    batches = out.groupBy(block_of("window", output_chunksize).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("window", "v"))).alias("_r"))
    batches = batches.select("batch", F.size("_r").cast("long").alias("actual_size"), F.col("_r.v").alias("windows"))
    if not yield_remainder:
        batches = batches.where(F.col("actual_size") == output_chunksize)
    if padding:
        zero = F.expr(f"transform(windows[0], x -> {'named_struct(%s)' % ', '.join(repr(f) + ', 0D' for f in ('re', 'im')) if is_complex(s.kind()) else 'x - x'})")
        batches = batches.withColumn("windows", F.concat("windows", F.array_repeat(zero, (F.lit(output_chunksize) - F.col("actual_size")).cast("int"))))
    return batches


def batchavg(s: Signal, batchsize: int, allow_remainder: bool = False, n: int | None = None) -> Signal:
    """Means of each batchsize successive samples, NaN left out (all NaN: NaN); of arrays entry by entry. A remainder is
    an error, or left out."""
    if batchsize < 1:
        raise ValueError("batchsize must be positive")
    n = s.length() if n is None else n
    rest = n % batchsize
    if rest and not allow_remainder:
        raise ValueError(f"{n} samples are no multiple of {batchsize}")
    df = s.df.where(F.col(s.idx) < n - rest) if rest else s.df
    if any(isinstance(s.kind(v), ArrayType) for v in s.values):
        s.value  # arrays come alone
        return batch_means(s.with_df(df), batchsize)

    def mean(name: str):
        if is_complex(s.kind(name)):
            bad = F.isnan(F.col(name)["re"]) | F.isnan(F.col(name)["im"])
            return F.struct(*[F.coalesce(F.avg(F.when(~bad, F.col(name)[p])), F.lit(float("nan"))).alias(p) for p in ("re", "im")])
        return F.coalesce(F.avg(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))), F.lit(float("nan")))

    out = df.groupBy(block_of(s.idx, batchsize).alias("idx")).agg(*[mean(v).alias(v) for v in s.values])
    return s.with_df(out, idx="idx")
