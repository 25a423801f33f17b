"""Near-duplicate embeddings by E8 lattice hashing, verified by cosine in double precision.

Each of `TABLES` tables projects unit vectors to two times eight dimensions by random directions of standard normal
components, so that a projection's scale does not depend on the vectors' dimension, and decodes both parts to the
nearest points of the E8 lattice: a cell. Each vector is entered in its own cell and in the neighbouring cells
that are nearest, one step away in one part. Vectors that meet in a cell are compared; a pair that meets in several is
counted in the one of least number. Cells of one vector are dropped before any vector travels; large cells are cut
into parts that are joined two by two, so that a task holds at most two parts. What leaves a task is a count for each
vector and edges of a spanning forest, never all pairs.

Vectors are compared only within one label and length. A null label, and a vector that is null, empty, zero or has null
or non-finite components, links with nothing: n_links 0, its own component. Equal vectors are one node, so that copies
are counted and not compared; repeated rows each count as a vector and get a row. A null vec_id is the smallest and is
told as null. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm.common import NULL_ID, cut, mix, partitions, read
from sigframe.llm.components import components, forest, spread_join
from sigframe.llm.e8 import nearest, probes

TABLES = 8
PARTS = 2
NEIGHBOURS = 1
#: A lattice unit, in standard deviations of a projected unit vector's coordinate. Pairs at the threshold of 0.98 meet
#: with probability above 0.99 at any dimension, random pairs of 64 dimensions or more hardly ever.
WIDTH = 1.4
#: Vectors in one part of a cell.
CHUNK = 1000
THRESHOLD = 0.98
#: Fills up lists of cells.
NONE = -(1 << 63)
SEED = 8


@lru_cache(maxsize=4)
def _directions(dimension: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dimension)).standard_normal((tables, PARTS * 8, dimension))


_TO_NUMBER = mix(np.arange(1, PARTS * 8 + 1, dtype=np.uint64))


def cells(unit: np.ndarray, space: np.ndarray, tables: int = TABLES, width: float = WIDTH, neighbours: int = NEIGHBOURS, seed: int = SEED) -> np.ndarray:
    """Numbers of the cells that each unit vector is entered in: vectors, tables * (1 + PARTS * neighbours)."""
    out = []
    for table, directions in enumerate(_directions(unit.shape[1], tables, seed)):
        y = unit @ directions.T / width
        home = [nearest(y[:, 8 * p : 8 * p + 8]) for p in range(PARTS)]
        near = [probes(y[:, 8 * p : 8 * p + 8], home[p], neighbours) for p in range(PARTS)]
        for p, n in [(-1, 0), *((p, n) for p in range(PARTS) for n in range(neighbours))]:
            point = np.concatenate([near[q][:, n] if q == p else home[q] for q in range(PARTS)], axis=1)
            doubled = np.rint(2 * point).astype(np.int64).view(np.uint64)
            out.append(mix(mix((doubled * _TO_NUMBER).sum(1, dtype=np.uint64)) + space + np.uint64(table)))
    return np.stack(out, 1).view(np.int64)


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length each, and their unit vectors."""
    values = batch.column("v")
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        x = flat[starts[rows][:, None] + np.arange(n)]
        x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (k, node; node null where the vector links with nothing) and nodes (node, space, v, copies): distinct
    vectors of a label, named by their least id's hash with the vector's."""
    v = vectors.select(F.col("vec_id"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = "coalesce(label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0), false)"
    v = v.withColumn("node", F.when(F.expr(good), F.xxhash64(F.lit(1), "label", "v"))).withColumn("space", F.xxhash64(F.lit(2), "label", F.size("v")))
    rows = cut(v.select("vec_id", "k", "node", "space", "v"))
    one = rows.filter("node is not null").groupBy("node").agg(F.first("space").alias("space"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("k").alias("least"))
    return rows.drop("space", "v"), cut(one)


def compared(one: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK, **settings) -> DataFrame:
    """Rows (a, b, n): with n null an edge of a forest, else n vectors that the node a is linked to (b null)."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            node, space = batch.column("node").to_numpy(), batch.column("space").to_numpy().view(np.uint64)
            for rows, unit in _units(batch):
                found = cells(unit, space[rows], **settings)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[rows], found.shape[1])), pa.array(found.ravel())], ["node", "cell"])

    entered = cut(one.select("node", "space", "v").mapInArrow(enter, "node bigint, cell bigint"))
    shared = entered.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = shared.select(F.col("cell").alias("c"), F.ceil(F.col("n") / float(chunk)).alias("parts"))
    live = cut(entered.join(shared, entered["cell"] == shared["c"]).select("node", "cell", "parts"))
    mine = live.groupBy(F.col("node").alias("m")).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    whole = one.join(mine, one["node"] == mine["m"]).select("node", "v", "copies", "cells")
    tasks = F.expr("transform(sequence(0L, parts - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
    placed = live.withColumn("own", F.expr("pmod(xxhash64(node), parts)")).select("node", "cell", "own", F.explode(tasks).alias("t"))
    placed = placed.select("node", "cell", "own", "t.i", "t.j").join(whole, "node")
    at = ["cell", "i", "j"]
    placed = placed.repartition(partitions(one.sparkSession), *at).sortWithinPartitions(*at)

    def solve(cell: int, i: int, j: int, own, node, unit, copies, mine) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(own == i)
        second = first if i == j else np.flatnonzero(own == j)
        a, b = [], []
        for at in range(0, len(first), 256):
            x, y = np.nonzero(unit[first[at : at + 256]] @ unit[second].T >= threshold)
            x, y = first[x + at], second[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for s in range(0, len(x), 20_000):  # of the cells in which the pair meets, the least counts it
                p, q = x[s : s + 20_000], y[s : s + 20_000]
                both = np.where((mine[p][:, :, None] == mine[q][:, None, :]).any(2) & (mine[p] != NONE), mine[p], np.iinfo(np.int64).max)
                keep = both.min(1) == cell
                a.append(p[keep])
                b.append(q[keep])
        x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (a, b))
        n = np.zeros(len(node), np.int64)
        np.add.at(n, x, copies[y])
        np.add.at(n, y, copies[x])
        counted = np.flatnonzero(n)
        return *forest(node[x], node[y]), node[counted], n[counted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if sum(map(len, held)) < 2:
                return
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            node = table.column("node").to_numpy()
            unit = None
            for rows, u in _units(table):
                unit = np.empty((len(node), u.shape[1])) if unit is None else unit
                unit[rows] = u
            lists = table.column("cells")
            counts = np.diff(lists.offsets.to_numpy())
            mine = np.full((len(node), int(counts.max())), NONE)
            mine[np.repeat(np.arange(len(node)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy()
            a, b, c, n = solve(*key, table.column("own").to_numpy(), node, unit, table.column("copies").to_numpy(), mine)
            if len(a) or len(c):
                none = [None] * len(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, c))), pa.array([*b.tolist(), *none], pa.int64()), pa.array([*[None] * len(a), *n.tolist()], pa.int64())], ["a", "b", "n"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in at], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)] if len(batch) else []
            for s, e in zip(cuts[:-1], cuts[1:]):
                now = tuple(keys[s].tolist())
                if now != key:
                    yield from done()
                    held, key = [], now
                held.append(batch.slice(s, e - s))
        yield from done()

    return placed.select(*at, "own", "node", "v", "copies", "cells").mapInArrow(run, "a bigint, b bigint, n bigint")


def linked(vectors: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label)."""
    rows, one = nodes(vectors)
    told = cut(compared(one, threshold, **settings))
    count = told.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = components(told.filter("n is null").select("a", "b"))
    own = one.select("node", "copies", "least").join(count, "node", "left")
    own = own.join(label, own["node"] == label["id"], "left").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least", F.coalesce("component", "node").alias("component"))
    first = own.groupBy("component").agg(F.min("least").alias("first"))
    own = spread_join(own, first, ["component"], ["node"]).select("node", "n_links", "first")
    out = spread_join(rows, own, ["node"], ["k"], "left").withColumn("first", F.coalesce("first", "k"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("first") != NULL_ID, F.col("first")).alias("component_id"), (F.col("first") == F.col("k")).alias("kept"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "embeddings"))


QUERIES = {"op2_lattice": op2_lattice}
ORACLES = {
    "op2_lattice": r"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings),
g as (select vec_id, label, e, sqrt(list_dot_product(e, e)) n from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
l as (select a.vec_id x, b.vec_id y from g a join g b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(x, y) as (select vec_id, vec_id from v union select r.x, l.y from r join l on r.y = l.x),
c as (select x, min(y) component_id from r group by x), k as (select x, count(*) n from l group by x)
select c.x as vec_id, coalesce(n, 0)::bigint as n_links, component_id, component_id = c.x as kept from c left join k on c.x = k.x
"""
}

