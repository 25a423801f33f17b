"""Convolution with a finite kernel, with and without a rate factor, and rational resampling.

Short kernels are a join of each sample with the few outputs it adds to, summed before and after the shuffle. Longer
ones go by blocks of outputs: each task gets the samples that its outputs need, a halo included, and nothing passes
between blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from sigframe.functions.complexes import is_complex, make, product, scaled
from sigframe.signal import BLOCK, Signal

#: Products per sample up to which the short form is taken.
SHORT = 32


def _kernel(kernel: Sequence) -> np.ndarray:
    h = np.asarray(kernel)
    if h.ndim != 1:
        raise ValueError("the kernel must have one axis")
    return h.astype(complex) if np.iscomplexobj(h) else h.astype(np.int64) if h.dtype.kind in "iub" else h.astype(float)


def _lits(h: np.ndarray) -> Column:
    if h.dtype.kind == "c":
        return F.array(*[make(F.lit(float(x.real)), float(x.imag)) for x in h])
    return F.array(*[F.lit(x.item()) for x in h])


def _whole(s: Signal, h: np.ndarray) -> bool:
    return isinstance(s.kind(), (ByteType, ShortType, IntegerType, LongType)) and h.dtype.kind == "i"


def _times(s: Signal, h: np.ndarray) -> Column:
    v, k = F.col("v"), F.col("h")
    if is_complex(s.kind()):
        return product(v, k) if h.dtype.kind == "c" else scaled(v, k.cast("double"))
    if h.dtype.kind == "c":
        return scaled(k, v.cast("double"))
    return v.cast("long") * k if _whole(s, h) else v.cast("double") * k.cast("double")


def _total(df: DataFrame, complex_: bool) -> DataFrame:
    if complex_:
        return df.groupBy("idx").agg(F.struct(F.sum("p.re").alias("re"), F.sum("p.im").alias("im")).alias("v"))
    return df.groupBy("idx").agg(F.sum("p").alias("v"))


def _dense(df: DataFrame, n: int, complex_: bool, whole: bool) -> DataFrame:
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")) if complex_ else F.lit(0 if whole else 0.0)
    return df.sparkSession.range(n).withColumnRenamed("id", "idx").join(df, "idx", "left").select("idx", F.coalesce("v", zero).alias("v"))


def _blocked(s: Signal, h: np.ndarray, low: str, high: str, n_out: int, size: int, solve) -> DataFrame:
    """By blocks of outputs. low and high: a sample's first and last output; solve(outputs, first sample, samples)."""
    complex_ = is_complex(s.kind()) or h.dtype.kind == "c"
    whole = _whole(s, h)
    re, im = (F.col("v")["re"], F.col("v")["im"]) if is_complex(s.kind()) else (F.col("v").cast("long" if whole else "double"), F.lit(0.0))
    df = s.df.select("idx", re.alias("re"), im.alias("im")).withColumn("b", F.explode(F.expr(f"sequence(({low}) div {size}L, ({high}) div {size}L)")))
    kind = "re double, im double" if complex_ else "v long" if whole else "v double"

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        outputs = np.arange(key[0] * size, min(n_out, (key[0] + 1) * size))
        idx = pdf["idx"].to_numpy()
        first = int(idx.min())
        values = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy() if complex_ else pdf["re"].to_numpy()
        x = np.zeros(int(idx.max()) - first + 1, values.dtype)
        x[idx - first] = values
        y = solve(outputs, first, x)
        return pd.DataFrame({"idx": outputs, "re": y.real, "im": y.imag} if complex_ else {"idx": outputs, "v": y})

    out = df.groupBy("b").applyInPandas(block, f"idx long, {kind}")
    return out.select("idx", F.struct("re", "im").alias("v")) if complex_ else out


def oaconvolve(s: Signal, kernel: Sequence, factor: int = 1, n: int | None = None, block: int = BLOCK) -> Signal:
    """y[i] = sum over k of kernel[k] * x[i - k*factor], all n + (M-1)*factor of them. Integers stay exact. An empty
    kernel or signal gives an empty signal."""
    if not isinstance(factor, (int, np.integer)) or isinstance(factor, bool) or factor < 1:
        raise ValueError("factor must be a positive integer")
    h, s = _kernel(kernel), s.normal()
    n = s.length() if n is None else n
    complex_, m = is_complex(s.kind()) or h.dtype.kind == "c", len(h)
    if not m or not n:
        return s.with_df(s.df.where(F.lit(False)))
    n_out = n + (m - 1) * factor
    if m <= SHORT:
        df = s.df.select("idx", "v", F.posexplode(_lits(h)).alias("k", "h"))
        out = _total(df.select((F.col("idx") + F.col("k").cast("long") * factor).alias("idx"), _times(s, h).alias("p")), complex_)
    else:
        size = max(block, 4 * (m - 1) * factor)

        def solve(outputs: np.ndarray, first: int, x: np.ndarray) -> np.ndarray:
            if factor == 1 and x.dtype.kind != "i":
                length = 1 << int(len(x) + m - 1).bit_length()
                y = np.fft.ifft(np.fft.fft(x, length) * np.fft.fft(h, length))[: len(x) + m - 1]
                y = y if x.dtype.kind == "c" or h.dtype.kind == "c" else y.real
            elif factor == 1:
                y = np.convolve(x, h)
            else:
                y = np.zeros(len(x) + (m - 1) * factor, np.result_type(x, h))
                for k, tap in zip(range(m), h):
                    y[k * factor : k * factor + len(x)] += tap * x
            at = outputs - first
            good = (at >= 0) & (at < len(y))
            result = np.zeros(len(outputs), y.dtype)
            result[good] = y[at[good]]
            return result

        out = _blocked(s, h, "idx", f"idx + {(m - 1) * factor}", n_out, size, solve)
    return s.with_df(_dense(out, n_out, complex_, _whole(s, h)) if n < factor else out)


def upfirdn(h: Sequence, s: Signal, up: int = 1, down: int = 1, flush: bool = True, n: int | None = None, block: int = BLOCK) -> Signal:
    """Zeros between samples, the kernel, and every down-th output. flush=False leaves out what comes after the last
    sample. The type is the common one of kernel and samples."""
    if up < 1 or down < 1:
        raise ValueError("up and down must be positive")
    h, s = _kernel(h), s.normal()
    n = s.length() if n is None else n
    complex_, m = is_complex(s.kind()) or h.dtype.kind == "c", len(h)
    if not m or not n:
        return s.with_df(s.df.where(F.lit(False)))
    last = (n - 1) * up + (m if flush else 1)
    n_out = -(-last // down)
    if -(-m // down) <= SHORT:
        # Only taps that meet a kept output: k = -idx*up modulo down.
        df = s.df.withColumn("k", F.explode(F.expr(f"filter(sequence(0L, {m - 1}L), k -> (idx * {up} + k) % {down} = 0)")) if m <= down else F.explode(F.expr(f"case when pmod(-idx * {up}, {down}L) < {m} then sequence(pmod(-idx * {up}, {down}L), {m - 1}L, {down}L) else cast(array() as array<bigint>) end")))
        df = df.select("idx", "v", "k", F.get(_lits(h), F.col("k").cast("int")).alias("h"))
        out = _total(df.select(F.expr(f"(idx * {up} + k) div {down}").alias("idx"), _times(s, h).alias("p")), complex_)
        out = out.where(F.col("idx") < n_out)
    else:
        reach = -(-m // up)

        def solve(outputs: np.ndarray, first: int, x: np.ndarray) -> np.ndarray:
            y = np.zeros(len(outputs), np.result_type(x, h))
            top = outputs * down // up
            for t in range(reach):
                i = top - t
                k = outputs * down - i * up
                good = (k < m) & (i >= first) & (i < first + len(x))
                y[good] += h[k[good]] * x[i[good] - first]
            return y

        size = max(block, 4 * (-(-m // down)))
        out = _blocked(s, h, f"(idx * {up} + {down - 1}) div {down}", f"least({n_out - 1}L, (idx * {up} + {m - 1}) div {down})", n_out, size, solve)
    return s.with_df(_dense(out, n_out, complex_, _whole(s, h)) if m < up or m < down else out)
