"""Reductions over the position: sum, mean, length; arrays reduce entry by entry, complex numbers part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sigframe.functions.complexes import is_complex
from sigframe.signal import Signal


def _reduced(s: Signal, how, empty) -> DataFrame:
    kind = s.kind()
    if is_complex(kind):
        return s.df.agg(F.struct(*[F.coalesce(how(F.col(s.value)[p]), empty).alias(p) for p in ("re", "im")]).alias("v"))
    if isinstance(kind, ArrayType):
        parts = s.df.select(F.posexplode(s.value).alias("pos", "x")).groupBy("pos").agg(how("x").alias("x"))
        return parts.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_r")).select(F.col("_r.x").alias("v"))
    return s.df.agg(F.coalesce(how(s.value), empty).alias("v"))


def sum(s: Signal) -> DataFrame:
    """v, one row; 0 for an empty signal. NaN stays NaN."""
    return _reduced(s, F.sum, F.lit(0))


def mean(s: Signal) -> DataFrame:
    """v, one row; null for an empty signal. NaN stays NaN."""
    return _reduced(s, F.avg, F.lit(None))


def length(s: Signal) -> DataFrame:
    """v, one row: the number of samples."""
    return s.df.agg(F.count("*").alias("v"))
