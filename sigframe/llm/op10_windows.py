"""Word windows that a document shares with one of a smaller id, found by difference-cover anchors.

D = {0, 1, 3, 8, 12, 18} is a difference cover modulo 31: for any two positions some shift below 31 takes both into D.
Runs of 20 words are hashed only where they start at such a position (modulo 31) of their document; any shared window
of 50 words holds such an anchor, aligned in both documents. Anchors extend over all windows that hold them: at once
where all 80 words around agree, else window by window.

A word goes when a window that covers it starts also in a document with a smaller id. Null texts are empty; a null
doc_id is the smallest; rows with one doc_id never remove each other's words; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigframe.llm.common import BLOCKS, blocks, byte_sums, dealt, mix, partitions, ranges, read, running, sections, span_hash, texts_in, unpack, words_of
from sigframe.llm.repeats import WHOLE, Marks, covered, doc_key, marked, positions, repeated

WINDOW = 50
#: A difference cover and its period.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
BACK = PERIOD - 1
_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Windows that a task combines at a time.
BATCH = 1_000_000
RECORD = ("<u8", "<u8", "<i8", "<i4", "<i4", "<i1")


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word."""
    starts, ends, first = words_of(data, offsets)
    return span_hash(byte_sums(data), starts, ends), first


def anchors(data: np.ndarray, offsets: np.ndarray):
    words, first = _hashed(data, offsets)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words)) - np.repeat(first[:-1], counts)
    n = counts[text]
    own = np.flatnonzero(_COVERED[at % PERIOD] & (at + ANCHOR <= n) & (n >= WINDOW))
    text, at, n = text[own], at[own], n[own]
    sums = running(words)
    low, high = own - np.minimum(at, BACK), own + np.minimum(n - at, WINDOW)
    return text, at, span_hash(sums, own, own + ANCHOR), mix(span_hash(sums, low, high) + (own - low).astype(np.uint64))


def closer(doubt: DataFrame) -> DataFrame:
    """Marks for the windows around doubtful anchors that start in a smaller document too."""
    buckets = partitions(doubt.sparkSession)

    def earlier(h, g, k):
        """True where an equal window is in a smaller document."""
        order = np.lexsort((k, g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        out = np.zeros(len(h), bool)
        out[order] = k[order] > k[first]
        return out

    def flush(held):
        h, g, k, th, at = (np.concatenate(x) for x in zip(*held))
        done = earlier(h, g, k)
        return blocks(np.where(done, doc_key(k, th), h), (h, g, k, th, at, done.astype(np.int8)), buckets)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for some, data, offsets in texts_in(batches):
            words, first = _hashed(data, offsets)
            one, two = running(words), running(words, 77)
            ks, ths = some.column("k").to_pylist(), some.column("th").to_pylist()
            for i, (part, many) in enumerate(zip(some.column("part").to_pylist(), some.column("many").to_pylist())):
                count, part = int(first[i + 1] - first[i]), part + many
                low = np.maximum(positions(part) - BACK, 0)
                high = np.minimum(positions(part), count - WINDOW)
                at = np.unique(ranges(low, np.maximum(high - low + 1, 0)))
                own = at + first[i]
                held.append((span_hash(one, own, own + WINDOW), span_hash(two, own, own + WINDOW), np.full(len(at), ks[i]), np.full(len(at), ths[i], np.int32), at.astype(np.int32)))
                n += len(at)
            if n >= BATCH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Marks]:
            for held in sections(batches):
                h, g, k, th, at, done = unpack(held, RECORD)
                out = np.flatnonzero(earlier(h, g, k) | (done > 0))
                yield k[out], th[out], at[out], np.full(len(out), WHOLE, np.int8)

        yield from marked(found(), buckets)

    return dealt(doubt.select("k", "th", "text", "part", "many").mapInArrow(find, BLOCKS)).mapInArrow(compare, BLOCKS)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, offsets in texts_in(batches):
            starts, ends, first = words_of(data, offsets)
            raw = data.tobytes()
            counts, removed, kept = [], [], []
            for i, (whole, part) in enumerate(zip(some.column("whole").to_pylist(), some.column("part").to_pylist())):
                n = int(first[i + 1] - first[i])
                a, p = positions(whole), positions(part)
                gone = covered(n, [(a - BACK, a + WINDOW), (p, p + WINDOW)]) if len(a) or len(p) else np.zeros(n, bool)
                stay = np.flatnonzero(~gone) + first[i]
                counts.append(n)
                removed.append(n - len(stay))
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept"])

    return repeated(docs, anchors, closer, by_document=True).mapInArrow(take, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return deduplicated(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_windows": op10_windows}
ORACLES = {
    "op10_windows": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50),
h as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from p),
f as (select h, min(doc_id) first from h group by h),
g as (select distinct doc_id, unnest(range(i, i + 50)) i from h join f using (h) where doc_id > first),
r as (select doc_id, list(i) gone from g group by doc_id),
x as (select d.doc_id, w, coalesce(gone, []) gone from d left join r on d.doc_id = r.doc_id),
k as (select x.doc_id, len(w)::bigint n_words, len(gone)::bigint n_removed, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(gone, z[2])), lambda z: z[1]), ' ') kept from x)
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from k
"""
}

