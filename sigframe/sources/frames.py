"""Binary frames: a source and a sink for files of typed arrays.

A frame is the word TUPLE, the number of arrays, then for each the word ARRAY, the length of its type string and the
string, the number of axes, the lengths of the axes, and the values in row-major order; integers are native 64-bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sigframe.operators.arrays import stacked, unstacked

MEMORY_LIMIT = 512 << 20


class TornFrame(ValueError):
    """A file ends inside a frame, or holds something else."""


def serialize_ndarray(array: np.ndarray, file: BinaryIO) -> None:
    array = np.asarray(array)
    name = array.dtype.str.encode("ascii")
    file.write(b"ARRAY" + np.int64(len(name)).tobytes() + name + np.int64(array.ndim).tobytes() + np.array(array.shape, np.int64).tobytes())
    file.write(array.tobytes())


def write_frame(arrays: Sequence[np.ndarray], file: BinaryIO) -> None:
    file.write(b"TUPLE" + np.int64(len(arrays)).tobytes())
    for a in arrays:
        serialize_ndarray(a, file)


def _take(file: BinaryIO, n: int) -> bytes:
    data = file.read(n)
    if len(data) != n:
        raise TornFrame(f"{n} bytes were due, {len(data)} are left")
    return data


def _number(file: BinaryIO, most: int, what: str) -> int:
    n = int(np.frombuffer(_take(file, 8), np.int64)[0])
    if not 0 <= n <= most:
        raise TornFrame(f"{what} is {n}; at most {most} is allowed")
    return n


def deserialize_ndarray(file: BinaryIO, memory_limit: int = MEMORY_LIMIT) -> np.ndarray:
    if _take(file, 5) != b"ARRAY":
        raise TornFrame("an array was due")
    kind = np.dtype(_take(file, _number(file, 1024, "a type's length")).decode("ascii"))
    axes = _number(file, 64, "the number of axes")
    shape = tuple(np.frombuffer(_take(file, 8 * axes), np.int64).tolist())
    size = int(np.prod(shape, dtype=object)) * kind.itemsize if axes else kind.itemsize
    if min(shape, default=0) < 0 or size > memory_limit:
        raise TornFrame(f"an array of {size} bytes is over the limit of {memory_limit}")
    return np.frombuffer(_take(file, size), kind).reshape(shape)


def read_frames(file: BinaryIO, memory_limit: int = MEMORY_LIMIT) -> Iterator[tuple[np.ndarray, ...]]:
    """Frames up to a clean end; TornFrame where the file ends inside one."""
    while word := file.read(5):
        if word != b"TUPLE":
            raise TornFrame("a frame was due")
        yield tuple(deserialize_ndarray(file, memory_limit) for _ in range(_number(file, 1 << 20, "the number of arrays")))


def IterableBinaryFileChunks(file: BinaryIO, memory_limit: int = MEMORY_LIMIT) -> Iterator:
    """Frames of an open file or socket file; frames of one array as that array."""
    for frame in read_frames(file, memory_limit):
        yield frame[0] if len(frame) == 1 else frame


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI: local (a folder that all machines share), HDFS or an object store."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    system, at = _located(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [at]
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".frames"))


class FramesReader(DataSourceReader):
    """A partition for each file. pos is a sample's place in its file; files are in the order of their numbers."""

    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.limit = int(options.get("memoryLimit", MEMORY_LIMIT))

    def partitions(self):
        return [_File(f, i) for i, f in zip(range(1 << 31), _files(self.path))]

    def read(self, partition):
        names = [f.name for f in self.schema.fields[2:]]
        pos = 0
        with _located(self.path)[0].open_input_stream(partition.path) as f:
            for frame in read_frames(f, self.limit):
                if len(frame) != len(names):
                    raise TornFrame(f"a frame has {len(frame)} arrays, the schema {len(names)} values")
                n = min(len(a) for a in frame)
                columns = [pa.array(np.full(n, partition.number, np.int64)), pa.array(np.arange(pos, pos + n))]
                columns += [unstacked(a[:n].astype(a.dtype.newbyteorder("="))) for a in frame]
                yield pa.RecordBatch.from_arrays(columns, [x.name for x in self.schema.fields])
                pos += n


class _Done(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class FramesWriter(DataSourceArrowWriter):
    """A file for each partition, named by its number, in frames of chunkSize samples. An attempt writes a file of its
    own in a folder of the job's; the job's commit moves those that count, and takes the folder away with the others."""

    def __init__(self, schema: StructType, options):
        self.schema, self.path, self.size = schema, options["path"], int(options.get("chunkSize", 65536))
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, at = _located(self.path)
        system.create_dir(f"{at}/{self.job}")
        target = f"{at}/{self.job}/{context.partitionId():06d}.{context.taskAttemptId()}"
        names = [f.name for f in self.schema.fields if f.name != "idx"]
        held: list[pa.RecordBatch] = []
        with system.open_output_stream(target) as f:
            for batch in batches:
                held.append(batch.select(names))
                rows = sum(map(len, held))
                if rows >= self.size:
                    table = pa.Table.from_batches(held).combine_chunks()
                    whole = rows // self.size * self.size
                    for i in range(0, whole, self.size):
                        self._frame(table.slice(i, self.size), f)
                    held = table.slice(whole).to_batches()
            if sum(map(len, held)):
                self._frame(pa.Table.from_batches(held).combine_chunks(), f)
        return _Done(target)

    def _frame(self, table: pa.Table, f) -> None:
        write_frame([stacked(c.combine_chunks()) for c in table.columns], f)

    def commit(self, messages):
        system, at = _located(self.path)
        for m in messages:
            if m is not None:
                name = m.path.rsplit("/", 1)[1].split(".")[0]
                system.move(m.path, f"{at}/{name}.frames")
        self.abort(messages)

    def abort(self, messages):
        system, at = _located(self.path)
        if system.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.job}")


class FramesSource(DataSource):
    """spark.read.format("frames").schema("file long, pos long, v double").load(folder); the folder must be one that all
    executors share."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "file long, pos long, v double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FramesReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FramesWriter(schema, self.options)


def chunks_to_binaryfile(df: DataFrame, path: str, idx: str = "idx", chunk_size: int = 65536, partitions: int | None = None, preprocessor: Callable[[DataFrame], DataFrame] | None = None, skip: int = 1) -> DataFrame:
    """Samples (idx and values) in order: by ranges of idx, a file for each. preprocessor and skip (of chunks) hold for
    what is written; df is given back as it was."""
    spark = df.sparkSession
    spark.dataSource.register(FramesSource)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = df.withColumnRenamed(idx, "idx")
    written = written.where((F.expr(f"idx div {int(chunk_size)}") % skip) == 0) if skip > 1 else written
    written = preprocessor(written) if preprocessor else written
    ordered = written.repartitionByRange(n, "idx").sortWithinPartitions("idx")
    ordered.write.format("frames").option("path", path).option("chunkSize", chunk_size).mode("append").save()
    return df


def binaryfile_to_chunks(spark: SparkSession, path: str, values: str = "v double") -> DataFrame:
    """idx and values of a folder of frames: places in files, and the files' lengths summed."""
    from pyspark.sql import Window

    spark.dataSource.register(FramesSource)
    df = spark.read.format("frames").schema(f"file long, pos long, {values}").load(path)
    before = df.groupBy("file").agg(F.count("*").alias("n"))
    before = before.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    names = [c for c in df.columns if c not in ("file", "pos")]
    return df.join(F.broadcast(before), "file").select((F.col("b") + F.col("pos")).alias("idx"), *names)
