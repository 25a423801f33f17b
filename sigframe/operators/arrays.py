"""Scans and means of samples that are arrays (one or more trailing axes, of one shape): numpy on Arrow batches, in order
of position, with what a block needs of the blocks before it as rows of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from sigframe.functions.complexes import COMPLEX, is_complex
from sigframe.signal import BLOCKS, Signal, block_of

#: Positions of the rows that come before a block's own: the sums of all groups of blocks before, of the blocks of its
#: group before, and the sample before.
GROUPS, NEAR, LAST = -3, -2, -1


def widened(kind: DataType, real: bool = False) -> str:
    """The type of sums: bigint for integers (double where real), else double, or complex."""
    if isinstance(kind, ArrayType):
        return f"array<{widened(kind.elementType, real)}>"
    return COMPLEX if is_complex(kind) else "bigint" if not real and kind.simpleString() in ("bigint", "int", "smallint", "tinyint") else "double"


def stacked(column: pa.Array) -> np.ndarray:
    """Arrow lists of one shape as an array with as many axes."""
    shape = [len(column)]
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        lengths = np.diff(column.offsets.to_numpy())
        if len(lengths) and (lengths != lengths[0]).any() or column.null_count:
            raise ValueError("all samples of a signal must have one shape")
        shape.append(int(lengths[0]) if len(lengths) else 0)
        column = column.flatten()
    if pa.types.is_struct(column.type):
        flat = column.field("re").to_numpy(zero_copy_only=False) + 1j * column.field("im").to_numpy(zero_copy_only=False)
    else:
        flat = column.to_numpy(zero_copy_only=False)
    return flat.reshape(shape)


def unstacked(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x).ravel()
    if np.iscomplexobj(flat):
        made = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat.real)), pa.array(np.ascontiguousarray(flat.imag))], ["re", "im"])
    else:
        made = pa.array(flat)
    for axis in range(x.ndim - 1, 0, -1):
        n, width = int(np.prod(x.shape[:axis])), x.shape[axis]
        made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), made)
    return made


def _runs(b: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)] if len(b) else []
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield int(b[s]), slice(s, e)


def _told(names: list[str], keys: list[list], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if values:
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), unstacked(np.stack(values))], names)


def _sums(step: Callable) -> Callable:
    """Sums of the increments of each block, or of the part of it that is in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            idx, x, keys, out = batch.column("idx").to_numpy(), stacked(batch.column("v")), [], []
            for b, part in _runs(batch.column("b").to_numpy()):
                if b != now:
                    now, last = b, None
                own, at = x[part], idx[part]
                if (at == LAST).any():
                    last = own[at == LAST][0]
                if len(own := own[at >= 0]):
                    keys.append(b)
                    out.append(step(own, last).sum(0))
                    last = own[-1]
            yield from _told(["b", "v"], [keys], out)

    return run


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (g, b, v) in order: the sums before each b in its g (where a b has several rows they are added), and
    with b null the sum of each g."""
    g_now = b_now = total = own = None
    for batch in batches:
        x, gs, bs, out = stacked(batch.column("v")), [], [], []
        for g, b, v in zip(batch.column("g").to_pylist(), batch.column("b").to_pylist(), x):
            if (g, b) != (g_now, b_now) and b_now is not None:
                gs, bs, out, total = [*gs, g_now], [*bs, b_now], [*out, total], total + own
                if g != g_now:
                    gs, bs, out = [*gs, g_now], [*bs, None], [*out, total]
            if g != g_now:
                total = np.zeros_like(v)
            own = v if (g, b) != (g_now, b_now) else own + v
            g_now, b_now = g, b
        yield from _told(["g", "b", "v"], [gs, bs], out)
    if b_now is not None:
        yield from _told(["g", "b", "v"], [[g_now, g_now], [b_now, None]], [total, total + own])


def scanned(s: Signal, step: Callable[[np.ndarray, np.ndarray | None], np.ndarray], block: int, real: bool = False, ordered: bool = False, add: bool = False, initial=0) -> Signal:
    """Running sums of step(samples, the sample before), plus initial, and (add) plus the samples. Steps that need the
    sample before are ordered; others are summed before any shuffle."""
    s = s.normal()
    kind = widened(s.kind(), real)
    n = max(1, int(s.spark.conf.get("spark.sql.shuffle.partitions")))
    rows = s.df.select(block_of("idx", block).alias("b"), "idx", F.col("v").cast(kind).alias("v"))
    if ordered:
        last = rows.groupBy("b").agg(F.max_by("v", "idx").alias("v"))
        rows = rows.unionByName(last.select((F.col("b") + 1).alias("b"), F.lit(LAST).cast("long").alias("idx"), "v"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "b").sortWithinPartitions("b", "idx")

    sums = (dealt(rows) if ordered else rows).mapInArrow(_sums(step), f"b bigint, v {kind}").withColumn("g", block_of("b", BLOCKS))
    schema = f"g bigint, b bigint, v {kind}"
    near = sums.select("g", "b", "v").repartition(n, "g").sortWithinPartitions("g", "b").mapInArrow(_before, schema)
    groups = near.where("b is null").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("b"), "v").repartition(1).sortWithinPartitions("b").mapInArrow(_before, schema)
    near = near.where("b is not null")
    far = near.select("g", "b").join(groups.where("b is not null").select(F.col("b").alias("g"), "v"), "g")
    rows = rows.unionByName(near.select("b", F.lit(NEAR).cast("long").alias("idx"), "v")).unionByName(far.select("b", F.lit(GROUPS).cast("long").alias("idx"), "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = carry = None
        for batch in batches:
            idx, x, keys, out = batch.column("idx").to_numpy(), stacked(batch.column("v")), [], []
            for b, part in _runs(batch.column("b").to_numpy()):
                if b != now:
                    now, last, carry = b, None, initial
                own, at = x[part], idx[part]
                carry = carry + own[at <= NEAR].sum(0) if (at <= NEAR).any() else carry
                if (at == LAST).any():
                    last = own[at == LAST][0]
                if len(own := own[at >= 0]):
                    upto = np.cumsum(step(own, last), axis=0) + carry
                    keys.append(at[at >= 0])
                    out.append(upto + own if add else upto)
                    last, carry = own[-1], upto[-1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), unstacked(np.concatenate(out))], ["idx", "v"])

    if isinstance(initial, float) or np.ndim(initial) or isinstance(initial, complex):  # sums take the type that the first needs
        kind = kind.replace("bigint", "double")
    return s.with_df(dealt(rows).mapInArrow(run, f"idx bigint, v {kind}"))


def batch_means(s: Signal, batchsize: int) -> Signal:
    """Means of each batchsize successive samples, entry by entry, NaN left out (all NaN: NaN). Sums and counts of what a
    batch of rows holds of each are made before the shuffle."""
    s = s.normal()
    kind = widened(s.kind(), True)
    counts = kind.replace(COMPLEX, "bigint").replace("double", "bigint")
    n = max(1, int(s.spark.conf.get("spark.sql.shuffle.partitions")))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, x = batch.column("b").to_numpy(), stacked(batch.column("v"))
            keys, sums, seen = [], [], []
            for key, part in _runs(b):
                good = ~np.isnan(x[part])
                keys.append(key)
                sums.append(np.where(good, x[part], 0).sum(0))
                seen.append(good.sum(0))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), unstacked(np.stack(sums)), unstacked(np.stack(seen).astype(np.int64))], ["b", "sums", "seen"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, count = None, None, None
        for batch in batches:
            keys, out = [], []
            for b, v, c in zip(batch.column("b").to_pylist(), stacked(batch.column("sums")), stacked(batch.column("seen"))):
                if b != now:
                    if now is not None:
                        keys.append(now)
                        out.append(np.where(count > 0, total / np.maximum(count, 1), np.nan))
                    now, total, count = b, v, c
                else:
                    total, count = total + v, count + c
            yield from _told(["idx", "v"], [keys], out)
        if now is not None:
            yield from _told(["idx", "v"], [[now]], [np.where(count > 0, total / np.maximum(count, 1), np.nan)])

    found = s.df.select(block_of("idx", batchsize).alias("b"), F.col("v").cast(kind).alias("v")).mapInArrow(parts, f"b bigint, sums {kind}, seen {counts}")
    return s.with_df(found.repartition(n, "b").sortWithinPartitions("b").mapInArrow(merged, f"idx bigint, v {kind}"))
