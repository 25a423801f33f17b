"""Frequency shifts, and noise of a band."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sigframe.functions.complexes import is_complex, product, scaled, turned
from sigframe.functions.design import butterworth_bandpass
from sigframe.functions.noise import normal
from sigframe.operators.iir import SIZE, sosfilt
from sigframe.operators.scan import cumsum
from sigframe.signal import Signal


def mix(s: Signal, frq: float, samplerate: float = 1) -> Signal:
    """Times exp(2 pi i * frq/samplerate * idx), the phase going on over the whole signal."""
    s = s.normal()
    turn = turned(F.col("idx").cast("double") * (2 * math.pi * frq / samplerate))
    return s.with_df(s.df.select("idx", (product(F.col("v"), turn) if is_complex(s.kind()) else scaled(turn, F.col("v").cast("double"))).alias("v")))


def brownian_noise(s: Signal, rms: float, frq_min: float, frq_max: float, order: int = 50, seed: int = 0, size: int = SIZE) -> Signal:
    """Noise at a signal's positions: white noise, summed and band-passed between two frequencies in cycles per sample,
    with the given root mean square. The same for a seed however the rows are dealt out."""
    std = math.sqrt(rms**2 * (2 * math.pi) ** 2 / 2 / (1 / frq_min - 1 / frq_max))
    white = s.with_df(s.df.select(F.col(s.idx).alias("idx"), (normal(F.col(s.idx), seed) * std).alias("v")), idx="idx", values=("v",))
    return sosfilt(np.asarray(butterworth_bandpass(order, frq_min, frq_max)), cumsum(white), size)


def add_brownian_noise(s: Signal, rms: float, frq_min: float, frq_max: float, order: int = 50, seed: int = 0) -> Signal:
    s = s.normal()
    noise = brownian_noise(s, rms, frq_min, frq_max, order, seed).df.withColumnRenamed("v", "_n").withColumnRenamed("idx", "_i")
    v = F.col("v")
    total = F.struct((v["re"] + F.col("_n")).alias("re"), v["im"].alias("im")) if is_complex(s.kind()) else v + F.col("_n")
    return s.with_df(s.df.join(noise, F.col("idx") == F.col("_i")).select("idx", total.alias("v")))
