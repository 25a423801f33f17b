"""Streams give what the batch operators give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigframe.operators.iir import run
from sigframe.streaming import processors

X = np.random.default_rng(7).standard_normal(60)
SOS = [[1.0, -1.0, 0.0, 1.0, -1.9, 0.95], [0.5, 0.0, -0.5, 1.0, -1.2, 0.7]]


@pytest.fixture
def stream(spark, tmp_path):
    kind = "idx long, v double, fin boolean"
    rows = [(i, float(v), False) for i, v in enumerate(X)] + [(len(X), 0.0, True)]
    for i, at in enumerate((0, 17, 18, 40)):
        part = rows[at : (17, 18, 40, 61)[i]]
        spark.createDataFrame(part[::-1], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go(f, **more):
        df = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = f(df, **more).writeStream.format("memory").queryName(f"q{id(f)}").option("checkpointLocation", str(tmp_path / f"c{id(f)}")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted((r["idx"], r["v"]) for r in spark.table(f"q{id(f)}").collect())
        assert [i for i, _ in got] == list(range(len(got)))
        return np.array([v for _, v in got])

    return go


def test_cumsum(stream):
    assert np.allclose(stream(lambda df: processors.stream_cumsum(df.where("not fin"), 3.0)), np.cumsum(X) + 3)


def test_oaconvolve(stream):
    h = [1.0, -2.0, 0.5]
    sparse = np.zeros(9)
    sparse[::4] = h
    assert np.allclose(stream(lambda df: processors.stream_oaconvolve(df, h, 4, end="fin")), np.convolve(X, sparse))


def test_upfirdn(stream):
    h = np.arange(1.0, 12)
    z = np.zeros((len(X) - 1) * 3 + 1)
    z[::3] = X
    assert np.allclose(stream(lambda df: processors.stream_upfirdn(df, h, 3, 2, end="fin")), np.convolve(z, h)[::2])


def test_sosfilt(stream):
    want = run(np.array(SOS), X[None], np.zeros((1, 2, 2)))[0][0]
    assert np.allclose(stream(lambda df: processors.stream_sosfilt(df.where("not fin"), SOS)), want)


def test_apply(stream):
    def body(chunk, carry=0.0):
        out = np.cumsum(chunk) + carry
        return out, out[-1]

    body.has_carry = True
    assert np.allclose(stream(lambda df: processors.stream_apply(body, df.where("not fin"))), np.cumsum(X))


@pytest.mark.parametrize("run_size", [7, 50, 1000])
def test_a_batch_comes_in_sorted_pieces(run_size):
    """However the samples of a batch arrive, a step gets them by position, a bounded piece at a time."""
    rng = np.random.default_rng(3)
    for n, ends in ((0, 0), (1, 1), (200, 0), (201, 2)):
        at = np.concatenate((rng.permutation(n), np.full(ends, n)))
        parts = [pd.DataFrame({"idx": some, "v": some * 0.5, "end": some == n}) for some in np.array_split(at, 9)]
        pieces = list(processors.ordered(iter(parts), run_size, 16))
        rows = np.concatenate([x for x, _ in pieces])
        assert rows["idx"].tolist() == list(range(n)) and rows["v"].tolist() == [i * 0.5 for i in range(n)]
        assert max(len(x) for x, _ in pieces) <= max(16, -(-n // run_size) + 1)
        assert [last for _, last in pieces] == [False] * (len(pieces) - 1) + [ends > 0]


def test_no_step_gets_a_large_batch_whole(spark, tmp_path):
    def step(held, at, x, end):
        most = max(held or 0, len(x))
        return most, at, np.full(len(at), float(most))

    n = 300_000
    spark.range(n).selectExpr("id as idx", "cast(id as double) as v").orderBy(F.desc("idx")).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("idx long, v double").parquet(str(tmp_path / "in"))
    made = processors.stateful(df, step).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    made.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.countDistinct("idx")).first()[0] == got.count() == n
    assert got.agg(F.max("v")).first()[0] <= 1 << 17
