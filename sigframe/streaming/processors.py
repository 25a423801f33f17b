"""Signals that are still arriving: stateful processors for Structured Streaming.

A series' samples come in order over the batches, and are sorted within each. The state holds what the next batch needs:
a carry, a filter's delay line. A step gets a batch's samples piece by piece; where they are many, they are sorted in runs
that lie in a temporary file meanwhile, so that a worker's memory does not follow the batch. (apply's bodies see each
batch as one chunk, so these are held whole.) There is no last batch, so what a kernel leaves at the end comes when a row says so (its
end column is true; its value is ignored).
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.iir import run, sections
from sigframe.operators.udf import normalize_bodyfun

#: Samples that are sorted at a time, and those that a step gets at a time.
RUN = 1 << 20
PIECE = 1 << 16
SAMPLE = np.dtype([("idx", "<i8"), ("v", "<f8")])
#: Stands for a null position, which comes last.
NO_PLACE = (1 << 63) - 1

Step = Callable[[object, np.ndarray, np.ndarray, bool], tuple[object, np.ndarray, np.ndarray]]


def merged(file: BinaryIO, runs: Sequence[tuple[int, int]], piece: int) -> Iterator[np.ndarray]:
    """The samples of a file's sorted runs (each from one row to another) by position, at most piece at a time."""
    each = max(1, piece // len(runs))
    at, heads = [a for a, _ in runs], [np.empty(0, SAMPLE) for _ in runs]
    while True:
        for i, (_, end) in enumerate(runs):
            if not len(heads[i]) and at[i] < end:
                n = min(each, end - at[i])
                file.seek(at[i] * SAMPLE.itemsize)
                heads[i] = np.frombuffer(file.read(n * SAMPLE.itemsize), SAMPLE)
                at[i] += n
        if not any(map(len, heads)):
            return
        # Up to the least last position of runs that go on in the file, all is there.
        upto = min((h["idx"][-1] for h, a, (_, end) in zip(heads, at, runs) if a < end), default=NO_PLACE)
        cuts = [int(np.searchsorted(h["idx"], upto, "right")) for h in heads]
        rows = np.concatenate([h[:k] for h, k in zip(heads, cuts)])
        heads = [h[k:] for h, k in zip(heads, cuts)]
        yield rows[np.argsort(rows["idx"], kind="stable")]


def ordered(parts: Iterator[pd.DataFrame], run: int = RUN, piece: int = PIECE) -> Iterator[tuple[np.ndarray, bool]]:
    """A batch's samples by position, at most piece at a time, the last of them (perhaps none) with whether the end row
    has come."""
    held, n, runs, end = [], 0, [], False
    with tempfile.TemporaryFile() as file:

        def taken() -> np.ndarray:
            rows = np.concatenate((np.empty(0, SAMPLE), *held))
            return rows[np.argsort(rows["idx"], kind="stable")]

        def keep() -> None:
            file.write(taken())
            start = runs[-1][1] if runs else 0
            runs.append((start, start + n))

        for pdf in parts:
            own = ~pdf["end"].to_numpy(bool)
            end |= not own.all()
            rows = np.empty(int(own.sum()), SAMPLE)
            rows["idx"], rows["v"] = pdf["idx"].to_numpy()[own], pdf["v"].to_numpy()[own]
            held.append(rows)
            n += len(rows)
            if n >= run:
                keep()
                held, n = [], 0
        if runs:
            keep()
            found = merged(file, runs, piece)
        else:
            whole = taken()
            found = (whole[at : at + piece] for at in range(0, len(whole), piece))
        held = []
        last = next(found, np.empty(0, SAMPLE))
        for rows in found:
            yield last, False
            last = rows
        yield last, end


def stateful(df: DataFrame, step: Step, idx: str = "idx", value: str = "v", series: str | None = None, end: str | None = None, out: str = "double", whole: bool = False) -> DataFrame:
    """step(state or None, positions, values, whether this is the end) -> (state, positions, values), for each series
    and piece of a batch of a streaming df, or each whole batch; (series,) idx, v come out."""
    key = F.col(series).cast("string") if series else F.lit("")
    place = F.coalesce(F.col(idx).cast("long"), F.lit(NO_PLACE))
    source = df.select(key.alias("series"), place.alias("idx"), F.col(value).cast("double").alias("v"), (F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)).alias("end"))

    def process(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        pieces = ordered(parts)
        if whole:
            rows, last = zip(*pieces)
            pieces = [(np.concatenate(rows), last[-1])]
        for rows, last in pieces:
            held, at, made = step(held, rows["idx"].copy(), rows["v"].copy(), last)
            made = pd.DataFrame({"series": key[0], "idx": at, "v": made})
            for i in range(0, len(made), PIECE):
                yield made.iloc[i : i + PIECE]
        state.update((pickle.dumps(held),))

    made = source.groupBy("series").applyInPandasWithState(process, f"series string, idx long, v {out}", "held binary", "append", "NoTimeout")
    return made.select("series", F.nullif("idx", F.lit(NO_PLACE)).alias("idx"), "v")


def stream_cumsum(df: DataFrame, initial: float = 0.0, **columns) -> DataFrame:
    def step(held, at, x, end):
        y = np.cumsum(x) + (initial if held is None else held)
        return (float(y[-1]) if len(y) else held), at, y

    return stateful(df, step, **columns)


def stream_apply(body: Callable, df: DataFrame, **columns) -> DataFrame:
    """body over each batch as a chunk."""

    def step(held, at, x, end):
        own, first = normalize_bodyfun(body)
        number, carry = (0, first) if held is None else held
        y, carry = own(number, x, carry)
        return (number + 1, carry), at, np.asarray(y)

    return stateful(df, step, **columns, whole=True)


def stream_oaconvolve(df: DataFrame, kernel: Sequence[float], factor: int = 1, **columns) -> DataFrame:
    """Outputs as soon as they are certain; the tail at the end row."""
    h = np.asarray(kernel, float)
    back = (len(h) - 1) * factor

    def step(held, at, x, end):
        start, past = (0, np.zeros(back)) if held is None else held
        z = np.concatenate((past, x, np.zeros(back if end else 0)))
        n = len(z) - back
        y = np.zeros(n)
        for k, tap in zip(range(len(h)), h):
            y += tap * z[back - k * factor : back - k * factor + n]
        return (start + n, z[len(z) - back :] if back else z[:0]), np.arange(start, start + n), y

    return stateful(df, step, **columns)


def stream_upfirdn(df: DataFrame, h: Sequence[float], up: int = 1, down: int = 1, **columns) -> DataFrame:
    """Outputs up to the last sample's place; the tail at the end row."""
    h = np.asarray(h, float)
    keep = -(-len(h) // up)

    def step(held, at, x, end):
        n, done, past = (0, 0, np.zeros(0)) if held is None else held
        z = np.concatenate((past, x))
        first, n = n - len(past), n + len(x)
        last = ((n - 1) * up + (len(h) if end else 1) + down - 1) // down if n else 0
        outputs = np.arange(done, max(done, last))
        y = np.zeros(len(outputs))
        for t in range(keep):
            i = outputs * down // up - t
            k = outputs * down - i * up
            good = (k < len(h)) & (i >= first) & (i < n)
            y[good] += h[k[good]] * z[i[good] - first]
        return (n, done + len(outputs), z[max(0, len(z) - keep - down) :]), outputs, y

    return stateful(df, step, **columns)


def stream_sosfilt(df: DataFrame, sos: Sequence[Sequence[float]], **columns) -> DataFrame:
    sos = sections(sos)

    def step(held, at, x, end):
        state = np.zeros((1, len(sos), 2)) if held is None else held
        y, state = run(sos, x[None, :], state)
        return state, at, y[0]

    return stateful(df, step, **columns)
