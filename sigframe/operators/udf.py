"""Functions of a user's own over chunks of samples in order, with a carry from chunk to chunk.

A body takes (chunk) or, by attributes, more: has_carry (it takes and returns a carry), has_counter (the chunk's number
comes first), initial_carry. Where nothing says what the first carry is, the body's own default holds, or None. Such a body is
sequential: a series is one task's work, streamed with bounded memory. Series side by side are what makes it parallel.
"""

from __future__ import annotations

import copy
import inspect
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigframe.signal import Signal

_NONE = object()


def _has_default(body: Callable, place: int) -> bool:
    try:
        given = [p for p in inspect.signature(body).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    except (TypeError, ValueError):  # a builtin that tells nothing
        return False
    return place < len(given) and given[place].default is not inspect.Parameter.empty


def normalize_bodyfun(body: Callable) -> tuple[Callable[[int, Any, Any], tuple[Any, Any]], Any]:
    """(number, chunk, carry) -> (chunk, carry), and the first carry (a marker where the body's default holds)."""
    has_carry, has_counter = getattr(body, "has_carry", False), getattr(body, "has_counter", False)
    first = copy.deepcopy(body.initial_carry) if hasattr(body, "initial_carry") else _NONE if _has_default(body, 1 + has_counter) else None

    def step(number: int, chunk: Any, carry: Any) -> tuple[Any, Any]:
        given = (number, chunk) if has_counter else (chunk,)
        if not has_carry:
            return body(*given), carry
        return body(*given) if carry is _NONE else body(*given, carry)

    return step, first


def chain(*bodies: Callable) -> Callable:
    """Bodies one after the other, each with a carry of its own."""
    steps = [normalize_bodyfun(b) for b in bodies]

    def body(number: int, chunk: Any, carry: Any = None) -> tuple[Any, Any]:
        carries = [f for _, f in steps] if carry is None else list(carry)
        for i, (step, _) in zip(range(len(steps)), steps):
            chunk, carries[i] = step(number, chunk, carries[i])
        return chunk, carries

    body.has_carry = body.has_counter = True
    return body


def per_entry(*bodies: Callable) -> Callable:
    """The i-th body for the i-th value column; further columns are left out."""
    steps = [normalize_bodyfun(b) for b in bodies]

    def body(number: int, chunk: Sequence, carry: Any = None) -> tuple[tuple, Any]:
        carries = [f for _, f in steps] if carry is None else list(carry)
        out = []
        for i, ((step, _), entry) in zip(range(len(steps)), zip(steps, chunk)):
            entry, carries[i] = step(number, entry, carries[i])
            out.append(entry)
        return tuple(out), carries

    body.has_carry = body.has_counter = True
    return body


def apply(body: Callable, s: Signal, chunk_size: int, schema: str, series: str | None = None, yield_carry: bool = False) -> Signal:
    """body over chunks of chunk_size samples of each series, in order.

    A chunk is an array, or a tuple of arrays for several value columns; so is what the body returns, as many samples as
    it got. schema has the types of the values that come out (comma-separated). yield_carry adds the carry after its
    chunk, as text, to each of the chunk's rows.
    """
    kinds = [k.strip() for k in schema.split(",")]
    names = ["v"] if len(kinds) == 1 else [f"v{i}" for i in range(len(kinds))]
    key = [series] if series else []
    idx, value_names, single = s.idx, s.values, len(s.values) == 1  # a signal itself must not go to the workers

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, carry = normalize_bodyfun(body)
        held, number, last, lead = [], 0, -1, None

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal carry, number
            columns = tuple(pdf[v].to_numpy() for v in value_names)
            made, carry = step(number, columns[0] if single else columns, carry)
            number += 1
            made = made if isinstance(made, tuple) else (made,)
            out = pd.DataFrame({**{k: pdf[k].to_numpy() for k in key}, "idx": pdf[idx].to_numpy(), **{n: list(np.asarray(m)) for n, m in zip(names, made)}})
            return out.assign(carry=repr(carry)) if yield_carry else out

        for pdf in parts:
            pdf = pdf.sort_values(idx) if not pdf[idx].is_monotonic_increasing else pdf
            if len(pdf):
                if pdf[idx].iloc[0] <= last:
                    raise RuntimeError("rows of a series came out of order")
                last = pdf[idx].iloc[-1]
            held.append(pdf)
            while sum(map(len, held)) >= chunk_size:
                lead = pd.concat(held)
                yield go(lead.iloc[:chunk_size])
                held = [lead.iloc[chunk_size:]]
        rest = pd.concat(held) if held else None
        if rest is not None and len(rest):
            yield go(rest)

    def by_series(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(parts)

    by_series.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    out_kind = ", ".join([*(f"{k} {dict(s.df.dtypes)[k]}" for k in key), "idx long", *(f"{n} {k}" for n, k in zip(names, kinds)), *(["carry string"] if yield_carry else [])])
    source = s.df.select(*key, F.col(s.idx).cast("long").alias(s.idx), *s.values)
    if series:
        ordered = source.repartition(series).sortWithinPartitions(series, s.idx)
        out = ordered.groupBy(series).applyInPandas(by_series, out_kind)
    else:
        ordered = source.repartition(1).sortWithinPartitions(s.idx)
        out = ordered.mapInPandas(run, out_kind)
    return s.with_df(out, idx="idx", values=tuple(names))
