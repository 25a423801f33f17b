"""Complex numbers as struct<re, im>: Spark has no such type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

COMPLEX = "struct<re:double,im:double>"


def is_complex(kind: DataType) -> bool:
    return isinstance(kind, StructType) and {f.name for f in kind.fields} == {"re", "im"}


def make(re: Column, im: Column | float = 0.0) -> Column:
    return F.struct(re.cast("double").alias("re"), (im if isinstance(im, Column) else F.lit(float(im))).cast("double").alias("im"))


def product(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def added(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def scaled(a: Column, by: Column) -> Column:
    return make(a["re"] * by, a["im"] * by)


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def turned(phase: Column) -> Column:
    """exp(i * phase)."""
    return make(F.cos(phase), F.sin(phase))
