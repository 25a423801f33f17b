"""Repeated byte strings, by suffixes in deep-shallow order.

A suffix that shares `WINDOW` bytes with another shares with it the rarest run of `GRAM` bytes among them (the one of
least hash, the leftmost of these). Only suffixes around such anchors that stand in more than one place are sorted:
each anchor brings the bytes around it, and its group's suffixes are put in order by multikey quicksort (ternary, on one
byte of each at a time) to a shallow depth; groups that agree so far are ordered by blind tries. The same is done with
the bytes to the left, read backwards. Places between which no common prefix in the order is shorter than n agree on n
bytes; places that agree so on the left and on the right of the anchor hold the same string of WINDOW bytes, and all but
the earliest of them repeat. Hashes only bring places together. Anchors in too many unlike places for one task are split
by their strings, each of which goes to the partition of its own hash and is compared by two hashes.

A byte goes when a string of WINDOW bytes that covers it starts earlier too: in a smaller doc_id, or before in the
same document. Null texts are empty; a null doc_id is the smallest; rows that agree in doc_id and text are one
document; texts that share a doc_id are ordered by a hash. Very long texts are read whole, and take memory in proportion
to their own length only. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigframe.llm.common import BLOCKS, _P, blocks, byte_sums, dealt, mix, partitions, powers, ranges, read, sections, span_hash, texts_in, unpack
from sigframe.llm.repeats import WHOLE, Marks, covered, doc_key, marked, positions, repeated

WINDOW = 100
GRAM = 32
BACK = WINDOW - GRAM
AROUND = BACK + WINDOW
#: Bytes that multikey quicksort looks at.
SHALLOW = 16
#: Strings that a task combines at a time.
BATCH = 1_000_000
NEAR = ("<u8", f"V{AROUND}", "<i8", "<i4", "<i4", "<i1", "<i1")  # anchor, bytes around, k, th, position, bytes left, right
FAR = ("<u8", "<u8", "<i8", "<i4", "<i4", "<i1")  # two hashes, k, th, start, done


def _grams(sums: np.ndarray) -> np.ndarray:
    n = len(sums) - GRAM
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return span_hash(sums, at, at + GRAM)


def anchors(data: np.ndarray, offsets: np.ndarray):
    sums = byte_sums(data)
    grams = _grams(sums)
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= WINDOW)
    starts = ranges(offsets[long], lengths[long] - WINDOW + 1)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= BACK + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if (rest := BACK + 1 - span) > 0:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    text = np.searchsorted(offsets, at, "right") - 1
    low, high = np.maximum(offsets[text], at - BACK), np.minimum(offsets[text + 1], at + WINDOW)
    return text, at - offsets[text], grams[at], mix(span_hash(sums, low, high) + (at - low).astype(np.uint64))


# ---- deep-shallow order -------------------------------------------------------------------------


class BlindTrie:
    """Orders strings that agree on a long beginning: inner nodes hold a depth and a byte for each branch, nothing of
    what was skipped, which one comparison with any leaf makes up for."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node[0], dict):
            branch = node[0].get(s[node[1]] if node[1] < len(s) else -1)
            node = branch if branch is not None else next(iter(node[0].values()))
        other = self.strings[node[0]]
        same = _common(s, other)
        if same == len(s) == len(other):
            node.append(i)
            return
        above = None
        node = self.root
        while isinstance(node[0], dict) and node[1] < same:
            above, node = node, node[0][s[node[1]] if node[1] < len(s) else -1]
        mine, theirs = (x[same] if same < len(x) else -1 for x in (s, other))
        if isinstance(node[0], dict) and node[1] == same:
            node[0][mine] = [i]
            return
        made = [{theirs: node, mine: [i]}, same]
        if above is None:
            self.root = made
        else:
            above[0][s[above[1]] if above[1] < len(s) else -1] = made

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node[0], dict):
                stack += [node[0][b] for b in sorted(node[0], reverse=True)]
            else:
                out += node
        return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def multikey(order: np.ndarray, run: np.ndarray, rows: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Ternary quicksort of the rows order[..] of each run by their bytes from start to stop, all runs at a time; what
    is left in one run then agrees on these bytes. run numbers the runs along order, from 0."""
    depth = np.full(int(run[-1]) + 1 if len(run) else 0, start)
    while True:
        size = np.bincount(run, minlength=len(depth))
        at = np.flatnonzero(((size > 1) & (depth < stop))[run])
        if not len(at):
            return order, run
        items, r = order[at], run[at]
        d = depth[r]
        byte = np.where(d < lengths[items], rows[items, np.minimum(d, rows.shape[1] - 1)].astype(np.int16) + 1, 0)  # 0: the end
        begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        n = np.diff(np.append(begin, len(r)))
        three = np.sort(np.stack((byte[begin], byte[begin + n // 2], byte[begin + n - 1])), axis=0)
        pivot = np.repeat(three[1], n)
        side = (byte > pivot).astype(np.int8) - (byte < pivot)
        by = np.argsort(r * 3 + side + 1, kind="stable")
        order[at], side, ended = items[by], side[by], (pivot == 0)[by]
        part = run * 3 + 1
        part[at] += side
        step = np.zeros(len(run), bool)
        step[1:] = part[1:] != part[:-1]
        after = np.cumsum(step)
        deeper = depth[run].copy()
        deeper[at] += side == 0
        deeper[at[(side == 0) & ended]] = stop  # equal to the end
        depth = np.zeros(int(after[-1]) + 1, np.int64)
        depth[after], run = deeper, after


def deep_shallow(group: np.ndarray, rows: np.ndarray, lengths: np.ndarray, start: int = 0, shallow: int = SHALLOW) -> np.ndarray:
    """An order of the rows (bytes, up to their lengths) by group and suffix; a group's rows agree up to start."""
    order = np.argsort(group, kind="stable")
    step = np.zeros(len(order), np.int64)
    step[1:] = group[order][1:] != group[order][:-1]
    order, run = multikey(order, np.cumsum(step), rows, lengths, start, min(start + shallow, rows.shape[1]))
    size = np.bincount(run) if len(run) else run
    ends = np.cumsum(size)
    for a, b in zip((ends - size)[size > 1].tolist(), ends[size > 1].tolist()):
        trie = BlindTrie([rows[i, start : lengths[i]].tobytes() for i in order[a:b]])
        for i in range(b - a):
            trie.add(i)
        order[a:b] = order[a:b][trie.order()]
    return order


def prefixes(group: np.ndarray, rows: np.ndarray, lengths: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The order, and how long a beginning each row in it shares with the row before: -1 where a group begins."""
    order = deep_shallow(group, rows, lengths, start)
    same = np.full(len(order), -1, np.int64)
    for at in range(0, len(order) - 1, 50_000):
        a, b = order[at : at + 50_000], order[at + 1 : at + 50_001]
        a = a[: len(b)]
        unlike = rows[a] != rows[b]
        n = np.where(unlike.any(1), unlike.argmax(1), rows.shape[1])
        same[at + 1 : at + 1 + len(b)] = np.where(group[a] == group[b], np.minimum(n, np.minimum(lengths[a], lengths[b])), -1)
    return order, same


def repeats_around(group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For b bytes before the anchor: the places whose string of WINDOW bytes from there stands at a place of lower rank
    too. rows hold BACK bytes before an anchor and WINDOW from it on; places of one rank are one."""
    n = len(group)
    ahead, same_ahead = prefixes(group, np.ascontiguousarray(rows[:, BACK:]), right, GRAM)
    behind, same_behind = prefixes(group, np.ascontiguousarray(rows[:, BACK - 1 :: -1]), left)
    most_ahead, most_behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for most, order, same in ((most_ahead, ahead, same_ahead), (most_behind, behind, same_behind)):
        most[order] = np.maximum(same, np.append(same[1:], -1))
    at_ahead, at_behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for b in range(BACK + 1):
        some = np.flatnonzero((most_ahead >= WINDOW - b) & (most_behind >= b))
        if not len(some):
            continue
        at_ahead[ahead] = np.cumsum(same_ahead < WINDOW - b)
        at_behind[behind] = np.cumsum(same_behind < b)
        alike = at_ahead[some] * (n + 1) + at_behind[some]
        by = np.lexsort((rank[some], alike))
        some, alike = some[by], alike[by]
        new = np.concatenate(([True], alike[1:] != alike[:-1]))
        first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        yield b, some[rank[some] > rank[first]]


# ---- the closer look ----------------------------------------------------------------------------


def _later(h, g, k, th, at) -> np.ndarray:
    """True where an equal string starts earlier. Rows that agree in all are one string."""
    order = np.lexsort((at, th, k, g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    out = np.zeros(len(h), bool)
    out[order] = (k[order] != k[first]) | (th[order] != th[first]) | (at[order] != at[first])
    return out


def _second(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1000)) * powers(_P, len(data)), out=out[1:])
    return out


def closer(doubt: DataFrame) -> DataFrame:
    buckets = partitions(doubt.sparkSession)

    def flush(held: list, kind: int) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        if kind:
            h, g, k, th, at = columns
            done = _later(*columns)
            return blocks(np.where(done, doc_key(k, th), h), (*columns, done.astype(np.int8)), buckets, 1)
        return blocks(columns[0], columns, buckets, 0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, n, m = [], [], 0, 0
        for some, data, offsets in texts_in(batches):
            sums, more = byte_sums(data), None
            ks, ths = some.column("k").to_pylist(), some.column("th").to_pylist()
            padded = None
            for i, (part, many) in enumerate(zip(some.column("part").to_pylist(), some.column("many").to_pylist())):
                start, end = int(offsets[i]), int(offsets[i + 1])
                if len(at := positions(part)):
                    if padded is None:
                        padded = np.concatenate((np.zeros(BACK, np.uint8), data, np.zeros(WINDOW, np.uint8)))
                    left, right = np.minimum(at, BACK), np.minimum(end - start - at, WINDOW)
                    rows = padded[(start + at)[:, None] + np.arange(AROUND)]
                    column = np.arange(AROUND)
                    rows[(column < BACK - left[:, None]) | (column >= BACK + right[:, None])] = 0
                    own = start + at
                    near.append((span_hash(sums, own, own + GRAM), rows.view(f"V{AROUND}").ravel(), np.full(len(at), ks[i]), np.full(len(at), ths[i], np.int32), at.astype(np.int32), left.astype(np.int8), right.astype(np.int8)))
                    n += len(at)
                if len(at := positions(many)):
                    more = _second(data) if more is None else more
                    low, high = np.maximum(at - BACK, 0), np.minimum(at, end - start - WINDOW)
                    at = np.unique(ranges(low, np.maximum(high - low + 1, 0)))
                    own = at + start
                    far.append((span_hash(sums, own, own + WINDOW), span_hash(more, own, own + WINDOW), np.full(len(at), ks[i]), np.full(len(at), ths[i], np.int32), at.astype(np.int32)))
                    m += len(at)
            if n * 8 >= BATCH:
                yield flush(near, 0)
                near, n = [], 0
            if m >= BATCH:
                yield flush(far, 1)
                far, m = [], 0
        if n:
            yield flush(near, 0)
        if m:
            yield flush(far, 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from marked((marks for held in sections(batches) for marks in judge(held)), buckets)

    def judge(held: list) -> Iterator[Marks]:
        if far := [x for x in held if memoryview(x)[0]]:
            h, g, k, th, at, done = unpack(far, FAR, 1)
            out = np.flatnonzero((done > 0) | _later(h, g, k, th, at))
            yield k[out], th[out], at[out], np.full(len(out), WHOLE, np.int8)
        if near := [x for x in held if not memoryview(x)[0]]:
            h, raw, k, th, pos, left, right = unpack(near, NEAR, 1)
            by = np.lexsort((pos, th, k))
            new = np.ones(len(by), bool)
            new[1:] = (k[by][1:] != k[by][:-1]) | (th[by][1:] != th[by][:-1]) | (pos[by][1:] != pos[by][:-1])
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(new)
            for b, out in repeats_around(h, raw.view(np.uint8).reshape(-1, AROUND), left.astype(np.int64), right.astype(np.int64), rank):
                yield k[out], th[out], pos[out] - np.int32(b), np.full(len(out), WHOLE, np.int8)

    return dealt(doubt.select("k", "th", "text", "part", "many").mapInArrow(find, BLOCKS)).mapInArrow(compare, BLOCKS)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) for each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, offsets in texts_in(batches):
            counts, removed, spans, hashes, kept = [], [], [], [], []
            for i, (whole, part) in enumerate(zip(some.column("whole").to_pylist(), some.column("part").to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                a, p = positions(whole), positions(part)
                if len(a) or len(p):
                    gone = covered(len(own), [(a - BACK, a + WINDOW), (p, p + WINDOW)])
                    spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    stays = own[~gone].tobytes()
                else:
                    spans.append(0)
                    stays = own.tobytes()
                counts.append(len(own))
                removed.append(len(own) - len(stays))
                kept.append(stays)
                hashes.append(hashlib.sha256(stays).hexdigest())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(x, pa.int64()) for x in (counts, removed, spans)), pa.array(hashes), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeated(docs, anchors, closer, by_document=False).mapInArrow(take, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op8_suffixes": op8_suffixes}
ORACLES = {
    "op8_suffixes": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) b from documents),
p as (select doc_id, b, unnest(range(0, len(b) // 2 - 99)) i from d where len(b) >= 200),
h as (select doc_id, i, md5(substr(b, 2 * i + 1, 200)) h from p),
k as (select doc_id, i, row_number() over (partition by h order by doc_id, i) n from h),
g as (select doc_id, i from k where n > 1),
v as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end first from g),
w as (select doc_id, i, sum(first) over (partition by doc_id order by i rows unbounded preceding) run from v),
m as (select doc_id, run, min(i) a, max(i) + 100 z from w group by 1, 2),
j as (select doc_id, count(*) n_spans, sum(z - a)::bigint n_removed, list({'a': a, 'z': z} order by a) spans from m group by 1),
x as (select d.doc_id, b, coalesce(n_spans, 0)::bigint n_spans, coalesce(n_removed, 0)::bigint n_removed, coalesce(spans, []) spans from d left join j on d.doc_id = j.doc_id)
select doc_id, (len(b) // 2)::bigint as n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(0, len(spans) + 1),
  lambda i: substr(b, case when i = 0 then 1 else 2 * spans[i].z + 1 end, case when i = len(spans) then len(b) else 2 * spans[i + 1].a end - case when i = 0 then 0 else 2 * spans[i].z end)), ''))) as kept_sha256 from x
"""
}

