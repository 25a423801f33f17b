"""Helpers shared by the corpus operators: lineage cuts, packed blocks of records, hashed words."""

from __future__ import annotations

import gc
import sys
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.signal import settled

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where ids are compared; it sorts before all others.
NULL_ID = -(1 << 63)
#: Bytes of text that a Python worker turns into 64-bit arrays at a time.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them: they are what grows with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that all executors share."""
    return settled(df)


def tidy(spark: SparkSession) -> None:
    """After a cut: lets Spark remove the shuffle files of the plan that was cut, which it does when nothing on the
    driver refers to them any more. What Python has dropped the JVM hears of from a thread that wakes once a second;
    collected before that, the files would stay."""
    gc.collect()
    untold = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    until = time.monotonic() + 10
    while untold and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(0.1)  # the last one is still on its way
    spark.sparkContext._jvm.System.gc()


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row of docs as one column, so that no name clashes, beside its key: row, k, th (as in keyed())."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text_of()).alias("th"))


def make_room() -> None:
    """Drops what another operator's tasks have kept in this worker for their next one: the worker is reused."""
    kept = sys.modules.get("sigframe.llm.op7_bpe")
    if kept is not None:
        kept.codec.cache_clear()


#: Rows of text that a Python worker turns into objects at a time; a batch, of which Spark bounds the bytes, has more.
ROWS = 256


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def text_of(column: str = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of a row: k orders documents (null first), th tells texts with one doc_id apart.

    Rows that agree in doc_id and text are one document to the operators; each still gets its own row in a result.
    """
    return docs.select("doc_id", text_of().alias("text")).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("th"), "text"
    )


# ---- packed records ----------------------------------------------------------------------------


def _planes(column: np.ndarray) -> bytes:
    """Signed columns byte by byte of their values, so that a shuffle's compression finds the zeros."""
    flat = np.ascontiguousarray(column)
    if flat.dtype.kind != "i" or flat.itemsize == 1:
        return flat.tobytes()
    return flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes()


def pack(columns: Sequence[np.ndarray]) -> bytes:
    return b"".join(_planes(c) for c in columns)


def unpack(blobs: Sequence, kinds: Sequence[str], skip: int = 0) -> list[np.ndarray]:
    """The columns of all blobs (bytes or buffers, without their first `skip` bytes), one after the other."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = (memoryview(blob).nbytes - skip) // width, skip
        for part, kind in zip(parts, map(np.dtype, kinds)):
            if kind.kind != "i" or kind.itemsize == 1:
                part.append(np.frombuffer(blob, kind, n, at))
            else:
                raw = np.frombuffer(blob, np.uint8, n * kind.itemsize, at)
                part.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n))
            at += n * kind.itemsize
    return [np.concatenate(p) if p else np.empty(0, k) for p, k in zip(parts, kinds)]


BLOCKS = "bucket int, block binary"
#: Sections of a partition's records: a worker works on one at a time, and Spark's sort, which spills, holds the others.
FINE = 8
#: Where a task has fewer records than this for a section of each partition, a partition's sections stay in one row.
FEW = 8


def blocks(key: np.ndarray, columns: Sequence[np.ndarray], parts: int, kind: int | None = None) -> pa.RecordBatch:
    """Rows of BLOCKS that hold the records packed, by section of their key's partition; a kind goes before each section.

    A row is one section, or, with few records, all sections of a partition behind their lengths. So there are never
    many more rows than partitions, or than records.
    """
    at = (key % np.uint64(parts * FINE)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(parts * FINE + 1))
    head = b"" if kind is None else bytes((kind,))
    section = lambda i: head + pack([c[order[ends[i] : ends[i + 1]]] for c in columns])
    found = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
    if len(key) >= FEW * FINE * parts:
        buckets, made = [i + i // FINE + 1 for i in found], [section(i) for i in found]
    else:
        whole: dict[int, list[bytes]] = {}
        for i in found:
            whole.setdefault(i // FINE, [b""] * FINE)[i % FINE] = section(i)
        buckets = [p * (FINE + 1) for p in whole]
        made = [np.array([len(x) for x in s], "<i4").tobytes() + b"".join(s) for s in whole.values()]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(made, pa.binary())], ["bucket", "block"])


def dealt(found: DataFrame) -> DataFrame:
    """Rows of BLOCKS in the session's number of partitions, each ordered by section."""
    return found.repartition(partitions(found.sparkSession), F.expr(f"bucket div {FINE + 1}")).sortWithinPartitions("bucket")


def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Buffer]]:
    """The packed records of each section of dealt rows."""
    part, held = None, [[] for _ in range(FINE)]
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            now, code = divmod(bucket, FINE + 1)
            if now != part:
                yield from (x for x in held if x)
                part, held = now, [[] for _ in range(FINE)]
            block = block.as_buffer()
            if code:
                for i in range(code - 1):  # the sections before this one are whole
                    if held[i]:
                        yield held[i]
                        held[i] = []
                held[code - 1].append(block)
            else:
                at = 4 * FINE
                for i, n in enumerate(np.frombuffer(block, "<i4", FINE).tolist()):
                    if n:
                        held[i].append(block.slice(at, n))
                        at += n
    yield from (x for x in held if x)


# ---- hashed words ------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    had = _powers.get(int(base))
    if had is None or len(had) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        had = _powers[int(base)] = np.multiply.accumulate(steps)
    return had[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def running(units: np.ndarray, salt: int = 0) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any run of units."""
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(mix(units.astype(np.uint64) + np.uint64(1 + salt)) * powers(_P, len(units)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of units[start:end], equal for equal runs wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_P_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_MIX = mix(np.arange(1, 257, dtype=np.uint64))


def byte_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_MIX[data] * powers(_P, len(data)), out=out[1:])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other, and each text's first word (with an end)."""
    word = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    last = inner[inner > 0] - 1
    after[last] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def texts_in(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their column text; more than most bytes only for one text."""
    make_room()
    for batch in batches:
        text = batch.column("text")
        if text.type != pa.large_binary():
            text = text.cast(pa.large_binary()) if text.type == pa.large_string() else text.cast(pa.binary()).cast(pa.large_binary())
        if not len(text):
            continue
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), whole[ends[at] : ends[to]], (ends[at : to + 1] - ends[at])
            at = to
        pa.default_memory_pool().release_unused()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, .. (counts[i] of them) for each i."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - firsts, counts)
