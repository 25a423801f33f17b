"""Signals: numeric streams as DataFrames with an explicit, dense, 0-based position.

Rows of a DataFrame have no order, so a sample's place is a column. A signal's values are one or more further columns:
numbers, structs (re, im) for complex numbers, or arrays for samples with trailing axes. Chunks are no part of a signal;
operators whose result shows chunks have a column for them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples of a block: what scans and filters work on at a time. Blocks of blocks bound what one task sees of them.
BLOCK = 1 << 14
BLOCKS = 1 << 12


@dataclass(frozen=True)
class Signal:
    """A DataFrame with position and value columns, and an identifier of where it comes from."""

    df: DataFrame
    idx: str = "idx"
    values: tuple[str, ...] = ("v",)
    identifier: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def value(self) -> str:
        if len(self.values) != 1:
            raise ValueError("this operator takes a signal with one value column")
        return self.values[0]

    def kind(self, name: str | None = None):
        return self.df.schema[name or self.value].dataType

    def with_df(self, df: DataFrame, **changes) -> Signal:
        return replace(self, df=df, **changes)

    def normal(self) -> Signal:
        """The same with columns idx and v (v0, v1, .. for several values), all others dropped."""
        names = ("v",) if len(self.values) == 1 else tuple(f"v{i}" for i in range(len(self.values)))
        cols = [F.col(a).alias(b) for a, b in zip(self.values, names)]
        return replace(self, df=self.df.select(F.col(self.idx).cast("long").alias("idx"), *cols), idx="idx", values=names)

    def length(self) -> int:
        """Samples, as an action: the sizes of results follow from it. Parquet answers from its footers."""
        return self.df.count()


def signal(df: DataFrame, idx: str = "idx", values: str | Sequence[str] = "v", identifier: str = "") -> Signal:
    """A DataFrame whose column idx is dense and 0-based."""
    return Signal(df, idx, (values,) if isinstance(values, str) else tuple(values), identifier)


def with_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """df with a dense 0-based position by a total order, without ever bringing all rows to one task: rows are dealt out
    by ranges of the order, numbered in each, and the few ranges' counts are summed."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt = settled(dealt)  # both uses must see one dealing
    counts = dealt.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    low = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + low).drop("_m", "_p", "_b")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it. One of our own only where there is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return (where or tempfile.mkdtemp(prefix="sigframe-")).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, so that a lost executor changes nothing of it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def block_of(idx: str, size: int) -> Column:
    """The number of the block of `size` positions that a position is in."""
    return F.expr(f"`{idx}` div {int(size)}L")
