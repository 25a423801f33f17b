"""Results kept by what they were made of."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sigframe.signal import Signal


def multihash(*args: str | bytes, binary: bool = False) -> str | bytes:
    """SHA-256 over the SHA-256 digests of all arguments; text as UTF-8."""
    parts = b"".join(hashlib.sha256(a.encode() if isinstance(a, str) else bytes(a)).digest() for a in args)
    made = hashlib.sha256(parts)
    return made.digest() if binary else made.hexdigest()


def multihash_columns(*columns):
    """The same for columns of strings."""
    return F.sha2(F.concat(*[F.unhex(F.sha2(c, 256)) for c in columns]), 256)


def identified(s: Signal, *identifiers: str) -> Signal:
    return s.with_df(s.df, identifier=multihash(*identifiers))


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cache(s: Signal, *identifiers: str | tuple[str, str], folder: str, active: bool = True) -> Signal:
    """The signal, computed once for its identifiers and kept as Parquet in a folder that all machines share.

    The first identifier may be (name, version). Without identifiers the result is kept for this call only. A result
    counts once its folder has the final name, which it gets when it is complete; leftovers of a broken run do not.
    """
    name, version = (identifiers[0] if isinstance(identifiers[0], tuple) else (identifiers[0], "0")) if identifiers else (uuid.uuid4().hex, "0")
    inputs = [i if isinstance(i, str) else ".".join(i) for i in identifiers[1:]]
    key = multihash(name, version, *inputs)
    if not active:
        return s.with_df(s.df, identifier=key)
    spark = s.spark
    target = f"{folder.rstrip('/')}/{multihash(name)[:12]}.{version}.{multihash(*inputs)}"
    fs, path = _file_system(spark, target)
    if not fs.exists(path):
        temporary = f"{target}.{uuid.uuid4().hex}.tmp"
        began = time.time()
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        s.df.repartitionByRange(n, s.idx).sortWithinPartitions(s.idx).write.parquet(temporary)
        spark.createDataFrame([(time.time() - began,)], "seconds double").coalesce(1).write.json(f"{temporary}/_computation_time")
        if not fs.rename(_file_system(spark, temporary)[1], path) and not fs.exists(path):
            raise OSError(f"{target} could not be written")
    return s.with_df(spark.read.parquet(target), identifier=key)
