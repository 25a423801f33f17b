"""The store of signals: Parquet in order of position, so that a range of positions reads the row groups it is in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigframe.operators.arrays import unstacked
from sigframe.operators.slicing import chunked, concatenate, reverse, zipped
from sigframe.signal import Signal, signal
from sigframe.sources.cache import multihash


def chunks_to_store(s: Signal, path: str, preprocessor: Callable[[DataFrame], DataFrame] | None = None, skip: int = 1, chunk_size: int = 1 << 14, mode: str = "errorifexists") -> Signal:
    """Write a signal, and give it back as it was. preprocessor and skip (of chunks) hold for the written copy only."""
    df = chunked(s, chunk_size, skip).drop("chunk") if skip > 1 else s.df
    df = preprocessor(df) if preprocessor else df
    n = max(1, int(s.spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n, s.idx).sortWithinPartitions(s.idx).write.mode(mode).parquet(path)
    return s


def array_to_store(spark: SparkSession, path: str, data: np.ndarray) -> None:
    """A small array from the driver; what was there is replaced."""
    data = np.asarray(data)
    v = [{"re": float(x.real), "im": float(x.imag)} for x in data] if np.iscomplexobj(data) else data.tolist()
    kind = "struct<re:double,im:double>" if np.iscomplexobj(data) else "array<" * (data.ndim - 1) + ("bigint" if data.dtype.kind in "iu" else "double") + ">" * (data.ndim - 1)
    spark.createDataFrame([*zip(range(len(v)), v)], f"idx bigint, v {kind}").write.mode("overwrite").parquet(path)


def array_from_store(spark: SparkSession, path: str) -> np.ndarray | tuple[np.ndarray, ...]:
    """All samples on the driver."""
    return concatenate(stored(spark, path))


def stored(spark: SparkSession, path: str | Sequence[str], values: Sequence[str] | None = None, reversed: bool = False) -> Signal:
    """A stored signal; several stores side by side, as long as the shortest; or last sample first."""
    if not isinstance(path, str):
        parts = zipped(*(stored(spark, p) for p in path))
        return reverse(parts) if reversed else parts
    df = spark.read.parquet(path)
    own = tuple(values or [c for c in df.columns if c != "idx"])
    s = signal(df.select("idx", *own), values=own, identifier=multihash(path))
    return reverse(s) if reversed else s


def from_hdf5(spark: SparkSession, path: str, name: str | Sequence[str] | None = None, chunksize: int | None = None, reversed: bool = False) -> Signal:
    """HDF5 datasets, a task for each few runs of chunks; needs h5py on all machines, and a path that they share.

    Without a name the dataset data, or data0, data1, .. side by side; several names are side by side, as long as the
    shortest. Samples with trailing axes are arrays.
    """
    import h5py

    with h5py.File(path, "r") as f:
        if name is None:
            name = "data" if "data" in f else [f"data{i}" for i in takewhile(lambda i: f"data{i}" in f, count())]
            if not name:
                raise KeyError(f"{path} has neither data nor data0")
        names = [name] if isinstance(name, str) else list(name)
        found = [(n, f[n].shape, f[n].dtype, f[n].chunks) for n in names]
    if chunksize is not None and len(found) > 1:
        raise ValueError("chunksize is for one dataset")
    parts = [_dataset(spark, path, n, shape, kind, chunksize or (chunks or (1 << 16,))[0]) for n, shape, kind, chunks in found]
    out = parts[0] if isinstance(name, str) else zipped(*parts)
    out = out.with_df(out.df, identifier=multihash(path, str(name), str(chunksize), str(reversed)))
    return reverse(out, min(shape[0] for _, shape, _, _ in found)) if reversed else out


def _dataset(spark: SparkSession, path: str, name: str, shape: tuple[int, ...], dtype: np.dtype, size: int) -> Signal:
    to = np.dtype("c16") if dtype.kind == "c" else np.dtype("i8") if dtype.kind in "iu" else np.dtype("f8")
    element = {"c": "struct<re:double,im:double>", "i": "bigint", "f": "double"}[to.kind]
    kind = "array<" * (len(shape) - 1) + element + ">" * (len(shape) - 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(path, "r") as f:
            for batch in batches:
                for start in batch.column("id").to_pylist():
                    x = np.asarray(f[name][start : start + size]).astype(to)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(x))), unstacked(x)], ["idx", "v"])

    return signal(spark.range(0, shape[0], size).mapInArrow(read, f"idx bigint, v {kind}"))
