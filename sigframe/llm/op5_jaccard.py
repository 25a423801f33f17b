"""N-gram Jaccard join with count vectors in an R-tree.

A document's set holds the hashes of its distinct runs of `words` words. Tokens are hashed into groups: the counts by
group are a point, and the overlap of two sets is at most the sum of the coordinates' minima. Points are packed into
R-trees (by size, then by the widest coordinate); a join of a tree with itself goes down where the bound of two boxes
still reaches the least overlap that the threshold asks for; pairs that are left are counted exactly.

At a similarity of 0.8 or 0.9 the boxes of all documents together would hardly ever exclude each other, and one tree
would be one task. So trees are built for clusters of documents that could link. For sets of sizes n <= m the
threshold t allows at most n(1-t)/t unlike tokens; with more groups than that, some group is the same in both. Each
document therefore emits a hash of each group's tokens (for the grid of group numbers of its size and of the size
below), and clusters are the components of documents that emit a hash in common. No link is lost, as groups that hold
nothing are made up for by further groups, or emitted themselves where they are more than these. There are further
groups still, a quarter more, so that documents that link have not one but more than these in common: those that share
fewer hashes with all others together (a passage that many documents hold gives a few) drop out before clusters form.
The others join clusters by their rarest hashes only: of those in common at least one is left when each document drops
as many of its commonest as are one too few for a link, so that what many documents hold does not chain them together.

Texts with fewer than `words` words have their whole sequence as the only token; without words or text the set is
empty and links with nothing. Documents with equal sets are one node. A null doc_id is the smallest and is told as
null; repeated rows each get a row; an empty table gives no row; other columns are kept by distinct_documents() only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigframe.llm.common import _LOWER, BLOCKS, NULL_ID, blocks, byte_sums, cut, dealt, keyed, mix, partitions, read, running, sections, span_hash, texts_in, tidy, unpack, whole_rows, words_of
from sigframe.llm.components import Union, components, spread_join

#: Coordinates of a point, entries of a leaf and of an inner node.
DIMENSIONS = 64
LEAF = 16
#: Tokens of the documents that one task joins, at about half of them for each of two parts of a larger cluster, whose
#: parts meet in rounds that send each text twice at most.
CHUNK = 1_500_000
#: Hashes that a task combines at a time.
BATCH = 1_000_000
NEAR = ("<u4", "<u2", "<i8")


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    low = _LOWER[data]
    starts, ends, first = words_of(low, offsets)
    sums = running(span_hash(byte_sums(low), starts, ends))
    at = np.arange(max(0, len(starts) - words + 1))
    tokens = span_hash(sums, at, at + words)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            yield np.unique(tokens[a : b - words + 1])
        elif b > a:
            yield span_hash(sums, np.array([a]), np.array([b]))
        else:
            yield np.empty(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """A set's number: the same for equal sets."""
    return int(mix(np.array([mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


class Grid:
    """For each size, the bands that it emits for, and the number of groups of each band."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        self.groups: dict[int, tuple[int, int, int]] = {}

    def _upto(self, n: int) -> None:
        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)

    def band(self, n: int) -> int:
        self._upto(n)
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def of(self, band: int) -> tuple[int, int, int]:
        """The groups of a band, how many of them may be empty, and how many may be common; none where no unlike sets
        can link."""
        if band not in self.groups:
            while len(self.lows) < band + 2:
                self._upto(self.lows[-1])
            unlike = (self.lows[band + 1] - 1) * (self.den - self.num) // self.num
            common = int(np.ceil((unlike + 1) / 4))
            groups = unlike + 1 + common
            empty = groups * np.exp(-self.lows[band] / groups)
            spare = int(1 + np.ceil(empty + 4 * np.sqrt(empty)))
            self.groups[band] = (groups + spare, spare, common) if unlike else (0, 0, 0)
        return self.groups[band]

    def hashes(self, tokens: np.ndarray) -> Iterator[np.ndarray]:
        """48 bits for each group; the last bit is the band's."""
        own = self.band(len(tokens))
        value = mix(tokens + np.uint64(0x2545F4914F6CDD1D))
        for band in (own, own - 1):
            groups, spare, _ = self.of(band) if band >= 0 else (0, 0, 0)
            if not groups:
                continue
            group = (tokens % np.uint64(groups)).astype(np.int64)
            total = np.zeros(groups, np.uint64)
            np.add.at(total, group, value)
            held = np.bincount(group, minlength=groups) > 0
            keep = np.arange(groups) if groups - held.sum() > spare else np.flatnonzero(held)
            h = mix(total[keep] + mix(keep.astype(np.uint64) + (np.uint64(band) << np.uint64(40)))) >> np.uint64(16)
            yield h & ~np.uint64(1) | np.uint64(band & 1)


# ---- R-tree -------------------------------------------------------------------------------------


def vectors(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), DIMENSIONS), np.int32)
    for row, tokens in zip(out, sets):
        row += np.bincount((tokens >> np.uint64(40)).astype(np.int64) % DIMENSIONS, minlength=DIMENSIONS).astype(np.int32)
    return out


class RTree:
    """Points packed in order of size, and within slabs of like size by the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * LEAF
        for at in range(0, len(order), slab):
            some = order[at : at + slab]
            order[at : at + slab] = some[np.argsort(points[some][:, points[some].var(0).argmax()], kind="stable")]
        self.order = order
        high, low, top = points[order], sizes[order], sizes[order]
        self.levels = [(high, low, top)]
        while len(high) > 1:
            cuts = np.arange(0, len(high), LEAF)
            high, low, top = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((high, low, top))

    def pairs(self, num: int, den: int, apart) -> Iterator[tuple[int, np.ndarray]]:
        """Entries x with arrays of entries y > x (both in packed order) within the bound; apart(x, ys) says which of
        them are still worth it."""
        stack = [(len(self.levels) - 1, 0, np.zeros(1, np.int64))]
        while stack:
            level, x, ys = stack.pop()
            high, low, top = self.levels[level]
            least = num * (low[x] + low[ys]) / (num + den)
            fits = (np.minimum(high[x], high[ys]).sum(1) >= least - 1e-9) & (top[x] * den >= num * low[ys]) & (top[ys] * den >= num * low[x])
            ys = ys[fits]
            if not len(ys):
                continue
            if level == 0:
                yield x, ys
                continue
            n = len(self.levels[level - 1][0])
            below = (ys[:, None] * LEAF + np.arange(LEAF)).ravel()
            below = below[below < n]
            for c in range(x * LEAF, min(n, (x + 1) * LEAF)):
                mine = below[below >= c] if level > 1 else below[below > c]
                if level == 1 and len(mine):
                    mine = mine[apart(c, mine)]
                if len(mine):
                    stack.append((level - 1, c, mine))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(b) < len(a):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges whose components are those of all pairs with a similarity of num/den or more. The tree chooses the pairs
    to be counted; what earlier links have joined already is left out."""
    if len(sets) < 2:
        return []
    tree, union, found = RTree(vectors(sets), np.array([len(s) for s in sets])), Union(len(sets)), []
    order = tree.order.tolist()
    label, fresh = np.arange(len(order)), 0
    for x, ys in tree.pairs(num, den, lambda x, ys: label[ys] != label[x]):
        for y in ys.tolist():
            p, q = order[x], order[y]
            if union.find(p) == union.find(q):
                continue
            both = overlap(sets[p], sets[q])
            if both and den * both >= num * (len(sets[p]) + len(sets[q]) - both):
                union.join(p, q)
                found.append((p, q))
                fresh += 1
        if fresh:
            label, fresh = np.array([union.find(i) for i in order]), 0
    return found


# ---- the join -----------------------------------------------------------------------------------


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k, th, n_shingles, node of each row; node is null where the set is empty."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, offsets in texts_in(batches):
            sets = list(token_sets(data, offsets, words))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("k"), some.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "k", "th", "n_shingles", "node"])

    return keyed(docs).mapInArrow(run, f"doc_id {kind}, k bigint, th bigint, n_shingles bigint, node bigint")


def shared_hashes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Rows (node, h) of hashes that two nodes or more emit."""
    buckets = partitions(docs.sparkSession)

    def halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(16)).astype(np.uint32), h.astype(np.uint16)

    def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order by hash, and where its runs begin and how long they are."""
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1])))
        return order, new, np.diff(np.append(new, len(h)))

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x for x, _ in held])
        node = np.repeat(np.array([n for _, n in held], np.int64), [len(x) for x, _ in held])
        order, new, counts = runs(h)
        shared = np.repeat(counts > 1, counts)
        own = order[~shared]
        yield blocks(mix(h[own]), (*halves(h[own]), node[own]), buckets, 0)
        if shared.any():  # known to be shared: the hash goes on once, its nodes wherever there is room
            own, one = order[shared], order[new[counts > 1]]
            yield blocks(mix(h[one]), halves(h[one]), buckets, 1)
            yield blocks(mix(node[own].view(np.uint64)), (*halves(h[own]), node[own]), buckets, 2)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, held, n, seen = Grid(num, den), [], 0, set()
        for _, data, offsets in texts_in(batches):
            for tokens in token_sets(data, offsets, words):
                if len(tokens) and (node := node_of(tokens)) not in seen:
                    seen.add(node)
                    for h in grid.hashes(tokens):
                        held.append((h, node))
                        n += len(h)
            if n >= BATCH:
                yield from flush(held)
                held, n, seen = [], 0, set()
        if n:
            yield from flush(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sections(batches):
            yield from met(*([x for x in held if memoryview(x)[0] == kind] for kind in range(3)))

    def met(alone: list, shared_in: list, sent_on: list) -> Iterator[pa.RecordBatch]:
        whole = lambda top, low: top.astype(np.uint64) << np.uint64(16) | low
        top, low, node = unpack(alone, NEAR, 1)
        h = whole(top, low)
        known = np.unique(whole(*unpack(shared_in, NEAR[:2], 1)))
        order, new, counts = runs(h)
        # Nodes are told twice where copies are met in several batches; told alone, such a pair is no sharing.
        alike = np.minimum.reduceat(node[order], new) == np.maximum.reduceat(node[order], new) if len(new) else np.empty(0, bool)
        shared = order[np.repeat(~alike | np.isin(h[order[new]], known), counts)]
        top, low, told = unpack(sent_on, NEAR, 1)
        for n, x in ((told, whole(top, low)), (node[shared], h[shared])):
            for at in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(n[at : at + 100_000]), pa.array(x[at : at + 100_000].view(np.int64))], ["node", "h"])

    found = keyed(docs).select("text").mapInArrow(find, BLOCKS)
    return dealt(found).mapInArrow(meet, "node bigint, h bigint").distinct()


def candidates(docs: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) whose components hold all nodes that could link."""
    grid = Grid(num, den)

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, odd in zip(batch.column("n").to_pylist(), batch.column("odd").to_pylist()):
                own = grid.band(n)
                out.append(grid.of(own if own & 1 == odd else own - 1)[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "odd", "m")), pa.array(out, pa.int64())], ["node", "odd", "m", "most"])

    shared = cut(shared_hashes(docs, words, num, den).withColumn("odd", F.col("h").bitwiseAND(F.lit(1)).cast("int")))
    tidy(docs.sparkSession)
    counted = shared.groupBy("node", "odd").agg(F.count("*").alias("m"))
    sizes = sets.filter("node is not null").groupBy(F.col("node").alias("own")).agg(F.first("n_shingles").alias("n"))
    many = counted.join(sizes, counted["node"] == sizes["own"]).select("node", "odd", "m", "n").mapInArrow(allowed, "node bigint, odd int, m bigint, most bigint")
    many = many.filter("m > most").select("node", "odd", (F.col("m") - F.col("most")).alias("room"))
    live = cut(shared.join(many, ["node", "odd"]).select("node", "odd", "h", "room"))
    del shared, counted, many
    tidy(docs.sparkSession)
    held = live.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("nodes"))
    # One order of all hashes, the rarest first. A window's rows are hashes of one document.
    order = Window.partitionBy("node", "odd").orderBy("nodes", "h")
    rare = live.join(held, live["h"] == held["g"]).withColumn("place", F.row_number().over(order))
    rare = cut(rare.filter("place <= room").select("node", "h"))
    del live, held
    tidy(docs.sparkSession)
    least = rare.groupBy(F.col("h").alias("g")).agg(F.min("node").alias("a"))
    return rare.join(least, rare["h"] == least["g"]).filter("a != node").select("a", F.col("node").alias("b")).distinct()


def verified(docs: DataFrame, sets: DataFrame, clusters: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) with the components of all links, from R-trees in each cluster(id, component) of nodes."""
    one = sets.filter("node is not null").groupBy("node").agg(F.min(F.struct("k", "th")).alias("one"), F.first("n_shingles").alias("n"))
    member = one.join(clusters, one["node"] == clusters["id"]).select("node", "one.k", "one.th", "n", "component")
    member = cut(member)
    parts = member.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(float(CHUNK // 2))).alias("parts"))
    most = parts.agg(F.max("parts")).first()[0] or 0
    placed = member.join(parts, "component").select("k", "th", "node", "component", "parts", F.expr("pmod(xxhash64(node), parts)").alias("own"))
    texts = keyed(docs).select("k", "th", "text").join(placed, ["k", "th"]).select("component", "parts", "own", "node", "text")
    at = ["component", "i", "j"]

    def solve(held: dict[int, np.ndarray]) -> tuple[list[int], list[int]]:
        nodes = sorted(held)
        found = links([held[x] for x in nodes], num, den)
        return [nodes[x] for x, _ in found], [nodes[y] for _, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for some, data, offsets in texts_in(batches):
            keys = list(zip(*(some.column(c).to_pylist() for c in at)))
            a, b = [], []
            for key, node, tokens in zip(keys, some.column("node").to_pylist(), token_sets(data, offsets, words)):
                if key != last:
                    x, y = solve(held)
                    a, b, held, last = a + x, b + y, {}, key
                held[node] = tokens
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = solve(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def meeting(texts: DataFrame, apart: int) -> DataFrame:
        """Edges from the tasks of parts that are so far apart, around the circle of a cluster's parts."""
        met = "pmod(own {0} {1}, parts)"
        pair = "struct(least(own, {0}) as i, greatest(own, {0}) as j)"
        tasks = ", ".join(pair.format(met.format(sign, apart)) for sign in "+-")
        tasks = F.expr(f"case when parts <= 2 then array(struct(0L as i, 1L as j)) else array_distinct(array({tasks})) end")
        texts = texts.select("component", "node", "text", F.explode(tasks).alias("t")).select("component", "t.i", "t.j", "node", "text")
        texts = texts.repartition(partitions(docs.sparkSession), *at).sortWithinPartitions(*at, "node")
        return texts.mapInArrow(run, "a bigint, b bigint")

    if most <= 2:
        return meeting(texts, 1)
    # A cluster of more than two parts is joined two by two of them; each pair of documents meets in some task. All pairs
    # at once would be a text for each other part, so those at one distance meet at a time.
    texts = cut(texts)
    tidy(docs.sparkSession)
    found = []
    for apart in range(1, most // 2 + 1):
        found.append(cut(meeting(texts.filter(F.col("parts") >= 2 * apart) if apart > 1 else texts, apart)))
        tidy(docs.sparkSession)
    return reduce(DataFrame.union, found)


def join(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, k, th, n_shingles, node, first (k of the component's smallest doc_id) for each row of docs."""
    sets = cut(sets_of(docs, words))
    clusters = components(cut(candidates(docs, sets, words, num, den)))
    tidy(docs.sparkSession)
    linked = components(cut(verified(docs, sets, clusters, words, num, den)))
    tidy(docs.sparkSession)
    own = sets.filter("node is not null").groupBy("node").agg(F.min("k").alias("least"))
    own = own.join(linked, own["node"] == linked["id"], "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    first = own.groupBy("component").agg(F.min("least").alias("first"))
    told = spread_join(own, first, ["component"], ["node"]).select("node", "first", F.col("component").alias("set_component"))
    out = spread_join(sets, told, ["node"], ["k", "th"], "left")
    return out.withColumn("first", F.coalesce("first", "k"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join(read(spark, sf_dir, "documents"), 3, 9, 10)
    return out.select("doc_id", "n_shingles", F.when(F.col("first") != NULL_ID, F.col("first")).alias("component_id"))


def distinct_documents(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs, all columns, that are the first (by doc_id, then by a hash of the text) of their component;
    of rows that agree in both, one. Documents with empty sets all stay."""
    found = cut(join(docs, words, num, den))
    tidy(docs.sparkSession)
    # One row of a component stays: the least (k, th) of those whose k is the component's first.
    best = found.filter("node is not null and k = first").groupBy("set_component").agg(F.min(F.struct("k", "th")).alias("one"))
    stay = best.select("one.k", "one.th", F.lit(True).alias("one"))
    stay = cut(stay.union(found.filter("node is null").select("k", "th", F.lit(False).alias("one")).distinct()))
    tidy(docs.sparkSession)
    # Of rows that agree in doc_id and text the first counts; the join has brought them together.
    again = Window.partitionBy("k", "th").orderBy("k")
    joined = whole_rows(docs).join(stay, ["k", "th"]).withColumn("n", F.row_number().over(again))
    return joined.filter("n = 1 or not one").select("row.*")


QUERIES = {"op5_jaccard": op5_jaccard}
ORACLES = {
    "op5_jaccard": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ') || ' '] else [] end) g from d),
n as (select doc_id, len(g)::bigint n from s),
t as (select doc_id, unnest(g) t from s),
c as (select a.doc_id x, b.doc_id y, count(*) o from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 90 * (a.n + b.n - o)),
u as (select x, y from e union all select y, x from e),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, u.y from r join u on r.other = u.x)
select n.doc_id, n.n as n_shingles, min(r.other) as component_id from n join r on r.doc_id = n.doc_id group by 1, 2
"""
}

