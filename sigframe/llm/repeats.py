"""Passages of a fixed length that repeat across documents: anchors, their surroundings, and what of them repeats.

Documents are runs of units (bytes or words). Each window of `window` units holds an anchor at most `back` units from
its start, and windows that are equal hold equal anchors at equal distances. So:

1. Each anchor goes, with the hash of its surroundings (the units of all windows that may hold it), to the partition
   of its own hash. An anchor that stands alone there is in no repeated window. Of equal anchors with equal
   surroundings all but the earliest repeat in full. Equal anchors with unequal surroundings need a closer look.
2. Documents with such anchors are looked up again, and a closer look (the operator's own) finds the starts of
   repeated windows there.
3. Each document gets what repeats in it.

Records are packed, and combined before each shuffle: of a surrounding that a task meets again and again, one goes on;
an anchor that a task meets in many surroundings is sure to need the closer look, so two witnesses go on for the rest.
The closer look may compare the places of one anchor with each other. Where they are too many for one task the group is
split: each of the windows there goes to a partition of its own hash, with nothing left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import BLOCKS, blocks, cut, dealt, keyed, mix, partitions, sections, texts_in, tidy, unpack

RECORD = ("<u8", "<u8", "<i8", "<i4", "<i4", "<i1")  # anchor, surroundings, k, th, position, state
MARK = ("<i8", "<i4", "<i4", "<i1")  # k, th, position, state
#: States: to be compared, repeated in full, in doubt among many, a witness of many.
OPEN, WHOLE, MANY, WITNESS = 0, 1, 2, 3
#: Unlike surroundings of one anchor that are too many for one task: in a task's batch, and in all.
MANY_HERE, MANY_IN_ALL = 128, 4096
#: Anchors that a task combines at a time.
BATCH = 1_000_000

Marks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Anchors = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # text's number, position, hash, surroundings


def marked(found: Iterator[Marks], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of MARK records, in few rows."""
    held, n = [], 0
    for marks in found:
        held.append(marks)
        n += len(marks[0])
        if n >= BATCH:
            yield _blocks_of(held, buckets)
            held, n = [], 0
    if n:
        yield _blocks_of(held, buckets)


def _blocks_of(held: list[Marks], buckets: int) -> pa.RecordBatch:
    k, th, pos, state = (np.concatenate(x) for x in zip(*held))
    return blocks(doc_key(k, th), (k, th, pos, state), buckets)


def documents(docs: DataFrame) -> DataFrame:
    return keyed(docs).withColumn("th", F.col("th").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def doc_key(k: np.ndarray, th: np.ndarray) -> np.ndarray:
    return mix(k.view(np.uint64) if k.dtype == np.int64 else k.astype(np.int64).view(np.uint64)) ^ mix(th.astype(np.uint64))


def combined(h: np.ndarray, around: np.ndarray, k: np.ndarray, th: np.ndarray, pos: np.ndarray, by_document: bool) -> np.ndarray:
    """True where an equal surrounding stands earlier: in a smaller document or, unless by_document, at a smaller position."""
    whole = np.zeros(len(h), bool)
    key = mix(h) + around  # brings equal ones together; both hashes decide
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    member = np.zeros(len(h), bool)
    member[1:] |= same
    member[:-1] |= same
    some = order[member]
    if len(some):
        some = some[np.lexsort((pos[some], th[some], k[some], around[some], h[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (h[some][1:] != h[some][:-1]) | (around[some][1:] != around[some][:-1])
        first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        whole[some] = (k[some] > k[first]) if by_document else ~new
    return whole


def _runs(h: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))


def anchored(docs: DataFrame, anchors: Callable[[np.ndarray, np.ndarray], Anchors], by_document: bool) -> DataFrame:
    """k, th, whole, part, many for documents with repeats: packed positions of anchors whose surroundings repeat in
    full, of those that need a closer look, and of those that need one and stand in many surroundings."""
    buckets = partitions(docs.sparkSession)

    def flush(held: list) -> pa.RecordBatch:
        h, around, k, th, pos = (np.concatenate(x) for x in zip(*held))
        state = np.where(combined(h, around, k, th, pos, by_document), WHOLE, OPEN).astype(np.int8)
        rest = np.flatnonzero(state == OPEN)
        rest = rest[np.argsort(h[rest], kind="stable")]
        new = _runs(h[rest])
        counts = np.diff(np.append(new, len(rest)))
        rest = rest[np.repeat(counts >= MANY_HERE, counts)]
        rest = rest[np.lexsort((around[rest], h[rest]))]
        new = _runs(h[rest])
        last = np.append(new[1:], len(rest))[: len(new)] - 1
        unlike = around[rest[new]] != around[rest[last]]
        state[rest[np.repeat(unlike, last - new + 1)]] = MANY
        seen = np.concatenate((rest[new[unlike]], rest[last[unlike]]))
        state, take = np.concatenate((state, np.full(len(seen), WITNESS, np.int8))), np.concatenate((np.arange(len(h)), seen))
        h, around, k, th, pos = h[take], around[take], k[take], th[take], pos[take]
        return blocks(np.where((state == WHOLE) | (state == MANY), doc_key(k, th), h), (h, around, k, th, pos, state), buckets)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for some, data, offsets in texts_in(batches):
            text, pos, h, around = anchors(data, offsets)
            k, th = some.column("k").to_numpy(zero_copy_only=False), some.column("th").to_numpy(zero_copy_only=False)
            held.append((h, around, k[text].astype(np.int64), th[text].astype(np.int32), pos.astype(np.int32)))
            n += len(h)
            if n >= BATCH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from marked((judge(*unpack(held, RECORD)) for held in sections(batches)), buckets)

    def judge(h, around, k, th, pos, state) -> Marks:
        rest = np.flatnonzero((state == OPEN) | (state == WITNESS))
        rest = rest[np.argsort(h[rest], kind="stable")]
        new = _runs(h[rest])
        counts = np.diff(np.append(new, len(rest)))
        some = rest[np.repeat(counts > 1, counts)]
        out = np.where(state == WITNESS, -1, np.where(state == OPEN, -1, state)).astype(np.int8)
        if len(some):
            whole = combined(h[some], around[some], k[some], th[some], pos[some], by_document)
            out[some[whole]] = WHOLE
            # A witness tells of records that some task has sent on as MANY, also where it repeats in full itself.
            new = _runs(h[some])
            told_many = np.repeat(np.logical_or.reduceat(state[some] == WITNESS, new), np.diff(np.append(new, len(some))))[~whole]
            left = some[~whole]  # still ordered by anchor
            if len(left):
                new = _runs(h[left])
                counts = np.diff(np.append(new, len(left)))
                unlike = np.minimum.reduceat(around[left], new) != np.maximum.reduceat(around[left], new)
                if by_document:
                    unlike &= np.minimum.reduceat(k[left], new) != np.maximum.reduceat(k[left], new)
                many = told_many[new] | unlike & (counts > MANY_IN_ALL)
                out[left] = np.repeat(np.where(many, MANY, np.where(unlike, OPEN, -1)), counts)
        out[state == WITNESS] = -1
        told = np.flatnonzero(out >= 0)
        return k[told], th[told], pos[told], out[told]

    found = dealt(documents(docs).select("k", "th", "text").mapInArrow(find, BLOCKS))
    return dealt(found.mapInArrow(compare, BLOCKS)).mapInArrow(by_text, MARKS)


MARKS = "k bigint, th int, whole binary, part binary, many binary"


def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of the marks."""
    for held in sections(batches):
        k, th, pos, state = unpack(held, MARK)
        order = np.lexsort((pos, th, k))
        k, th, pos, state = k[order], th[order], pos[order], state[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (th[1:] != th[:-1]))))
        ends = np.append(new[1:], len(k))
        for at in range(0, len(new), 10_000):
            a, b = new[at : at + 10_000], ends[at : at + 10_000]
            parts = [pa.array([pos[i:j][state[i:j] == w].tobytes() for i, j in zip(a, b)], pa.binary()) for w in (WHOLE, OPEN, MANY)]
            yield pa.RecordBatch.from_arrays([pa.array(k[a]), pa.array(th[a]), *parts], ["k", "th", "whole", "part", "many"])


def repeated(docs: DataFrame, anchors, closer: Callable[[DataFrame], DataFrame], by_document: bool) -> DataFrame:
    """doc_id, text, whole, part of each row of docs: packed positions of anchors with repeated surroundings, and packed
    starts of repeated windows; null where there are none. closer(k, th, text, part, many) gives blocks of MARK records."""
    marks = cut(anchored(docs, anchors, by_document))
    tidy(docs.sparkSession)
    texts = documents(docs)
    doubt = texts.select("k", "th", "text").join(marks.filter((F.length("part") > 0) | (F.length("many") > 0)).select("k", "th", "part", "many"), ["k", "th"])
    starts = dealt(closer(doubt)).mapInArrow(by_text, MARKS)
    starts = cut(starts.select("k", "th", F.col("whole").alias("part")))
    tidy(docs.sparkSession)
    joined = texts.join(marks.select("k", "th", "whole"), ["k", "th"], "left").join(starts, ["k", "th"], "left")
    return joined.select("doc_id", "text", "whole", "part")


def covered(n: int, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """True at units in any of the spans, which are cut at 0 and n."""
    steps = np.zeros(n + 1, np.int64)
    for a, b in spans:
        np.add.at(steps, np.clip(a, 0, n), 1)
        np.add.at(steps, np.clip(b, 0, n), -1)
    return np.cumsum(steps[:-1]) > 0


def positions(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", "<i4").astype(np.int64)
