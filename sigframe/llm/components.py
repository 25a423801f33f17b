"""Connected components of a graph given by its edges, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import cut, partitions

MERGED = 16
#: Edges that one task turns into components, in some 100 MB; more pass labels in rounds.
FEW = 1_000_000


class Union:
    """Union-find over numbers 0..n-1; the least number of a set stands for it."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least, other) with the components of the edges (a, b), one for each node but the least."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook larger roots to smaller ones, shorten all ways, keep the edges that still join two roots
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, y, x)
        while (root != root[root]).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[own]], nodes[own]


def thinned(edges: DataFrame, tasks: int) -> DataFrame:
    """edges(a, b) in so many tasks, the edges of each replaced by a forest, in steps of bounded size. (A large component
    has a forest in each.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        held, n = [], 0

        def grown() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate((x, *(batch.column(c).to_numpy() for batch in held))) for x, c in ((a, "a"), (b, "b"))))

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= max(100_000, len(a)):
                a, b = grown()
                held, n = [], 0
                if len(a) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.empty(0, np.int64)
        a, b = grown()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.coalesce(tasks).filter("a != b").select("a", "b").mapInArrow(run, "a bigint, b bigint")


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of all nodes of the edges."""
    held = [np.empty((2, 0), np.int64), *(np.stack((x.column("a").to_numpy(), x.column("b").to_numpy())) for x in batches)]
    least, other = forest(*np.concatenate(held, axis=1))
    roots = np.unique(least)
    ids, component = np.concatenate((roots, other)), np.concatenate((roots, least))
    for at in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (ids, component)], ["id", "component"])


#: Tasks that the rows of one key are spread over in a join.
SALTS = 32


def spread_join(many: DataFrame, few: DataFrame, on: Sequence[str], by: Sequence[str], how: str = "inner") -> DataFrame:
    """many joined with few, which has one row for each key, where a key may stand in a great part of many's rows: these
    go to SALTS tasks by a hash of the columns `by`, and few's row to as many of them as have any."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    needed = salted.select(*on, "_salt").distinct().join(few, list(on))
    return salted.join(needed, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """id, component for each node of edges(a, b), both bigint; component is the least id that it reaches. edges should
    be cut or read from a table, as few tasks read them.

    Edges are replaced by forests in ever fewer tasks. Where a few are left, one task is enough: a round has six shuffles
    of all partitions, and what the driver holds grows with each. Otherwise labels pass along edges and jump to their
    label's label, so that the rounds are about the logarithm of the longest path. Hubs are combined before the shuffle
    that takes least labels; in joins, a round's rows of a hub or a label are left to Spark's splitting of skewed
    partitions, as salting each round would double its shuffles.
    """
    thin, tasks = edges, partitions(edges.sparkSession)
    while True:
        tasks = max(1, tasks // MERGED)
        thin = cut(thinned(thin, tasks))
        left = thin.count()
        if left <= few:
            return cut(thin.coalesce(1).mapInArrow(solved, "id bigint, component bigint"))
        if tasks == 1 or left > 4 * few:
            break
    both = cut(thin.union(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        told = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(told, labels["id"] == told["a"]).select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        root = near.select(F.col("id").alias("r"), F.col("label").alias("jumped"))
        step = cut(near.join(root, near["label"] == root["r"], "left").select("id", "was", F.least("label", F.coalesce("jumped", "label")).alias("label")))
        changed = step.filter("label != was").limit(1).count()
        labels = step.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
