"""Recursive filters in second-order sections, in parallel.

A filter's state after a block is A^m times its state before it, plus the state that the block's m samples leave when
they start from rest; A is one sample's effect on the state. So blocks are filtered from rest, their end states are put
together (in groups of BLOCKS blocks, then over the few groups), and blocks are filtered again from their true states.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigframe.functions.complexes import is_complex
from sigframe.operators.slicing import reverse
from sigframe.signal import BLOCKS, Signal, block_of, settled

#: Samples of a block, and blocks that are filtered side by side: vector operations run over blocks.
SIZE = 1 << 12
SIDE_BY_SIDE = 64


def sections(sos: Sequence[Sequence[float]]) -> np.ndarray:
    sos = np.atleast_2d(np.asarray(sos, float))
    if sos.ndim != 2 or sos.shape[1] != 6 or not np.allclose(sos[:, 3], 1):
        raise ValueError("sos must have rows b0, b1, b2, 1, a1, a2")
    return sos


def run(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of x filtered from its state (rows, sections, 2): the output, and the states at the end."""
    y, z = np.array(x, float), np.array(state, float)
    for t in range(y.shape[1]):
        u = y[:, t]
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            out = b0 * u + z[:, i, 0]
            z[:, i, 0] = b1 * u - a1 * out + z[:, i, 1]
            z[:, i, 1] = b2 * u - a2 * out
            u = out
        y[:, t] = u
    return y, z


def step_matrix(sos: np.ndarray) -> np.ndarray:
    """A: the state after one sample of silence, for each unit state (as columns)."""
    n = 2 * len(sos)
    _, z = run(sos, np.zeros((n, 1)), np.eye(n).reshape(n, len(sos), 2))
    return z.reshape(n, n).T


def _rows(pdf: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, their samples in rows (zeros behind a last short one), each sample's row and place."""
    blocks, row = np.unique(pdf["b"].to_numpy(), return_inverse=True)
    place = (pdf["idx"].to_numpy() % size).astype(int)
    x = np.zeros((len(blocks), size))
    x[row, place] = pdf["v"].to_numpy()
    return blocks, x, row, place


def _filter_real(s: Signal, sos: np.ndarray, size: int) -> Signal:
    n_states = 2 * len(sos)
    a = step_matrix(sos)
    df = s.df.select("idx", F.col("v").cast("double").alias("v"), block_of("idx", size).alias("b")).withColumn("g", block_of("b", SIDE_BY_SIDE))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks, x, row, _ = _rows(pdf, size)
        counts = np.bincount(row)
        out = []
        for m in np.unique(counts):  # a short block must not run on into zeros
            some = np.flatnonzero(counts == m)
            _, z = run(sos, x[some, :m], np.zeros((len(some), len(sos), 2)))
            out.append(pd.DataFrame({"b": blocks[some], "m": m, "z": list(z.reshape(len(some), n_states))}))
        return pd.concat(out)

    states = df.groupBy("g").applyInPandas(ends, "b long, m long, z array<double>").withColumn("h", block_of("b", BLOCKS))

    def through(pdf: pd.DataFrame, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        powers: dict[int, np.ndarray] = {}
        before = []
        for m, z in zip(pdf["m"], pdf["z"]):
            before.append(c)
            if m not in powers:
                powers[m] = np.linalg.matrix_power(a, int(m))
            c = powers[m] @ c + np.asarray(z)
        return c, before

    def group_end(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = through(pdf.sort_values("b"), np.zeros(n_states))
        return pd.DataFrame({"h": pdf["h"].iloc[:1], "m": [int(pdf["m"].sum())], "c": [c]})

    def carried(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(n_states)
        for pdf in parts:
            c, before = through(pdf.rename(columns={"c": "z"}), c)
            yield pd.DataFrame({"h": pdf["h"].to_numpy(), "c": before})

    # A row for BLOCKS * SIZE samples: these few go through one task, a batch at a time.
    groups = states.groupBy("h").applyInPandas(group_end, "h long, m long, c array<double>")
    first = groups.repartition(1).sortWithinPartitions("h").mapInPandas(carried, "h long, c array<double>")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        _, before = through(pdf, np.asarray(pdf["c"].iloc[0]))
        return pd.DataFrame({"b": pdf["b"].to_numpy(), "c": before})

    starts = states.join(first, "h").groupBy("h").applyInPandas(carry, "b long, c array<double>")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks, x, row, place = _rows(pdf, size)
        at = np.zeros(len(blocks), int)
        at[row] = np.arange(len(row))
        state = np.stack(pdf["c"].iloc[at].to_list()).reshape(len(blocks), len(sos), 2)
        y, _ = run(sos, x[:, : place.max() + 1], state)
        return pd.DataFrame({"idx": pdf["idx"].to_numpy(), "v": y[row, place]})

    # The state goes with the first sample of a block only.
    starts = starts.select((F.col("b") * size).alias("idx"), "c")
    out = df.join(starts, "idx", "left")

    def final_sparse(pdf: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(pdf["b"][pdf["c"].notna()], pdf["c"][pdf["c"].notna()]))
        return final(pdf.assign(c=pdf["b"].map(own)))

    return s.with_df(out.groupBy("g").applyInPandas(final_sparse, "idx long, v double"))


def sosfilt(sos: Sequence[Sequence[float]], s: Signal, size: int = SIZE) -> Signal:
    """The causal filter, from rest."""
    sos, s = sections(sos), s.normal()
    if not is_complex(s.kind()):
        return _filter_real(s, sos, size)
    re, im = (_filter_real(s.with_df(s.df.select("idx", F.col("v")[p].alias("v"))), sos, size).df for p in ("re", "im"))
    both = re.withColumnRenamed("v", "_re").join(im.withColumnRenamed("v", "_im"), "idx")
    return s.with_df(both.select("idx", F.struct(F.col("_re").alias("re"), F.col("_im").alias("im")).alias("v")))


def sosfiltfilt(sos: Sequence[Sequence[float]], s: Signal, size: int = SIZE, n: int | None = None) -> Signal:
    """The filter forwards, then backwards; no padding, each from rest."""
    n = s.length() if n is None else n
    once = sosfilt(sos, s, size)
    once = once.with_df(settled(once.df))  # two passes read it
    back = sosfilt(sos, reverse(once, n), size)
    return reverse(back, n)
