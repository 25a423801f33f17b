"""Queries of the stream operators on the driver's tables, and the SQL that they equal.

events.value by event_id is the canonical signal; in cents, so that sums are exact in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe import api
from sigframe.functions.design import butterworth_bandpass
from sigframe.signal import Signal, shared_folder, signal
from sigframe.streaming import processors

CENTS = "cast(round(value * 100) as bigint)"
#: Of the noise, in cycles per sample.
BAND = (0.01, 0.1)
#: Three slow-pole sections: radius 0.99 to 0.999.
SOS = [[1.0, -1.0, 0.0, 1.0, -2 * r * float(np.cos(w)), r * r] for r, w in ((0.99, 0.1), (0.995, 0.3), (0.999, 0.7))]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def cents(spark: SparkSession, d: str) -> Signal:
    return signal(_events(spark, d).select(F.col("event_id").alias("idx"), F.expr(CENTS).alias("v")))


def values(spark: SparkSession, d: str) -> Signal:
    return signal(_events(spark, d).select(F.col("event_id").alias("idx"), F.col("value").alias("v")))


def orders(spark: SparkSession, d: str) -> Signal:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return signal(o.select(F.col("o_orderkey").alias("idx"), F.expr("cast(round(o_totalprice * 100) as bigint)").alias("v")))


def vectors(spark: SparkSession, d: str) -> Signal:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return signal(e.select(F.col("vec_id").alias("idx"), F.expr("transform(embedding, x -> cast(x as double))").alias("v")))


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batchavg(spark, sf_dir)


def _batchavg(s: SparkSession, d: str) -> DataFrame:
    out = api.batchavg(values(s, d), 16, allow_remainder=True)
    return out.df.select("idx", F.round("v", 6).alias("v"))


def _sliding(s: SparkSession, d: str) -> DataFrame:
    return api.sliding_window(cents(s, d), 17, 11).select("window", F.expr("aggregate(v, 0L, (a, x) -> a + x)").alias("total"), F.expr("v[0]").alias("first"), F.expr("v[16]").alias("last"))


def _sliding_coefficients(s: SparkSession, d: str) -> DataFrame:
    out = api.sliding_window(cents(s, d), [1.0, 2.0, -3.0, 2.0, 1.0], 3)
    return out.select("window", F.expr("cast(aggregate(v, 0D, (a, x) -> a + x) as bigint)").alias("total"))


def _sliding_batches(s: SparkSession, d: str) -> DataFrame:
    out = api.sliding_window(cents(s, d), 5, 7, output_chunksize=13, padding=True)
    return out.select("batch", "actual_size", F.size("windows").cast("long").alias("padded_size"), F.expr("aggregate(flatten(windows), 0L, (a, x) -> a + x)").alias("total"))


def _rechunk(overlap: int, padding: bool):
    def query(s: SparkSession, d: str) -> DataFrame:
        out = api.rechunk(cents(s, d), 100, overlap, padding=padding)
        return out.select("chunk", "actual_size", F.size("v").cast("long").alias("n"), F.expr("v[0]").alias("first"), F.expr("aggregate(v, 0L, (a, x) -> a + x)").alias("total"))

    return query


def _combine(s: SparkSession, d: str) -> DataFrame:
    out = api.combine_chunks(api.rechunk(cents(s, d), 64), 3)
    return out.select("chunk", "actual_size", F.expr("aggregate(v, 0L, (a, x) -> a + x)").alias("total"), F.expr("v[0]").alias("first"))


def _unwrap(s: SparkSession, d: str) -> DataFrame:
    tau, pi = 6.283185307179586, 3.141592653589793
    x = values(s, d)
    x = api.mapped(x, F.col("v") - tau * F.floor(F.col("v") / tau) - pi)
    return api.unwrap(x, block=1 << 10).df.select("idx", F.round("v", 6).alias("v"))


def _mix(s: SparkSession, d: str) -> DataFrame:
    return api.mix(values(s, d), 1.0 / (32 * np.pi), 1.0).df.select("idx", F.round("v.re", 6).alias("re"), F.round("v.im", 6).alias("im"))


def _complex_conv(s: SparkSession, d: str) -> DataFrame:
    x = cents(s, d)
    z = x.with_df(x.df.select("idx", F.struct(F.col("v").cast("double").alias("re"), F.col("idx").cast("double").alias("im")).alias("v")))
    return api.oaconvolve(z, [1 + 2j, -3j, 2 + 0j]).df.select("idx", "v.re", "v.im")


def _long_conv(s: SparkSession, d: str) -> DataFrame:
    return api.oaconvolve(cents(s, d), [(k * 7) % 11 - 5 for k in range(100)]).df


def _apply(s: SparkSession, d: str) -> DataFrame:
    def running(chunk, carry=0):
        out = np.cumsum(chunk) + carry
        return out, int(out[-1])

    running.has_carry = True
    return api.apply(running, cents(s, d), 1000, "long").df


def _chain(s: SparkSession, d: str) -> DataFrame:
    def twice(chunk):
        return 2 * chunk

    def running(chunk, carry):
        out = np.cumsum(chunk) + carry
        return out, int(out[-1])

    running.has_carry, running.initial_carry = True, 5
    return api.apply(api.chain(twice, running), cents(s, d), 777, "long").df


def _apply_series(s: SparkSession, d: str) -> DataFrame:
    def running(chunk, carry=0):
        out = np.cumsum(chunk) + carry
        return out, int(out[-1])

    running.has_carry = True
    e = _events(s, d).select("user_id", F.col("event_id").alias("idx"), F.expr(CENTS).alias("v"))
    return api.apply(running, signal(e), 16, "long", series="user_id").df


def _per_entry(s: SparkSession, d: str) -> DataFrame:
    both = api.zipped(cents(s, d), orders(s, d))
    return api.apply(api.per_entry(lambda x: x + 1, lambda x: -x), both, 500, "long, long").df


def _cache(s: SparkSession, d: str) -> DataFrame:
    x = api.mapped(cents(s, d), F.col("v") * 2)
    folder = _shared(s)
    api.cache(x, ("twice", "1"), d, folder=folder)
    return api.cache(x, ("twice", "1"), d, folder=folder).df


def _binary(s: SparkSession, d: str) -> DataFrame:
    folder = _shared(s)
    api.chunks_to_binaryfile(cents(s, d).df, folder, chunk_size=300)
    return api.binaryfile_to_chunks(s, folder, "v long")


def _binary_skip(s: SparkSession, d: str) -> DataFrame:
    folder = _shared(s)
    api.chunks_to_binaryfile(cents(s, d).df, folder, chunk_size=50, skip=4, preprocessor=lambda df: df.withColumn("v", F.col("v") + 2))
    return api.binaryfile_to_chunks(s, folder, "v long")


def _store(s: SparkSession, d: str) -> DataFrame:
    folder = _shared(s)
    api.chunks_to_store(cents(s, d), folder, skip=3, chunk_size=50, preprocessor=lambda df: df.withColumn("v", F.col("v") - 1))
    return api.stored(s, folder).df


def _hash(s: SparkSession, d: str) -> DataFrame:
    from sigframe.sources.cache import multihash_columns

    return _events(s, d).select("event_id", multihash_columns("event_type", "props").alias("h"))


def _filtered(both: bool):
    def query(s: SparkSession, d: str) -> DataFrame:
        f = api.sosfiltfilt if both else api.sosfilt
        return f(SOS, values(s, d), size=1000).df.select("idx", F.round("v", 0 if both else 3).alias("v"))

    return query


def _concatenate(s: SparkSession, d: str) -> DataFrame:
    x = api.concatenate(cents(s, d))
    return s.createDataFrame([(len(x), int(x[0]), int(x[-1]), int(x[::7].sum()))], "n long, first long, last long, every_seventh long")


def _entries(df: DataFrame) -> DataFrame:
    return df.select("idx", F.posexplode("v").alias("pos", "x")).select("idx", "pos", F.round("x", 6).alias("x"))


def _axis0_padded(s: SparkSession, d: str) -> DataFrame:
    out = api.rechunk(vectors(s, d), 64, 10, padding=True)
    return out.select("chunk", "actual_size", F.size("v").cast("long").alias("n"), F.round(F.expr("aggregate(flatten(v), 0D, (a, x) -> a + x)"), 6).alias("total"), F.expr("size(element_at(v, -1))").cast("long").alias("width"))


def _chain_none(s: SparkSession, d: str) -> DataFrame:
    def scale(chunk, carry):
        return chunk * 2, carry

    def add_one(chunk, carry):
        return chunk + 1, carry

    scale.has_carry = add_one.has_carry = True
    return api.apply(api.chain(scale, add_one), cents(s, d), 640, "long").df


def _per_entry_none(s: SparkSession, d: str) -> DataFrame:
    def scale(chunk, carry):
        return chunk * 2, carry

    def pass_through(chunk, carry):
        return chunk, carry

    scale.has_carry = pass_through.has_carry = True
    return api.apply(api.per_entry(scale, pass_through), api.zipped(cents(s, d), orders(s, d)), 500, "long, long").df


def _stored_pair(s: SparkSession, d: str) -> DataFrame:
    return api.reverse(api.zipped(cents(s, d), orders(s, d))).df.select("idx", "v0", "v1")


def _with_index(s: SparkSession, d: str) -> DataFrame:
    li = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    return api.with_index(li, ["c_acctbal", "c_custkey"]).select("idx", "c_custkey")


def _axis0(how):
    def query(s: SparkSession, d: str) -> DataFrame:
        return how(vectors(s, d)).select(F.posexplode("v").alias("pos", "x")).select("pos", F.round("x", 6).alias("x"))

    return query


def _fft(s: SparkSession, d: str) -> DataFrame:
    """A map of rows of arrays by a numpy function: the power of the first harmonics of each embedding."""
    @F.pandas_udf("array<double>")
    def power(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.abs(np.fft.rfft(np.stack(v.to_numpy()), axis=1)[:, :4]) ** 2)) if len(v) else v

    return vectors(s, d).df.select("idx", power("v").alias("p")).select("idx", F.posexplode("p").alias("k", "p")).select("idx", "k", F.round("p", 5).alias("p"))


def _streamed(f, out: str, kind: str):
    """f over the events arriving as four files, the last with the end row; the results as columns out of the type."""

    def query(s: SparkSession, d: str) -> DataFrame:
        folder, x = _shared(s), cents(s, d)
        n = x.length()
        rows = x.df.select("idx", F.col("v").cast("double").alias("v"), F.lit(False).alias("fin"))
        for part in range(4):
            some = rows.where((F.col("idx") >= n * part // 4) & (F.col("idx") < n * (part + 1) // 4))
            if part == 3:
                some = some.union(s.range(1).select(F.lit(n), F.lit(0.0), F.lit(True)))
            some.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = s.readStream.schema("idx long, v double, fin boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        made = f(arriving).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        made.awaitTermination()
        return s.read.parquet(f"{folder}/out").select("idx", F.expr(out).cast(kind).alias("v"))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "batchavg_16": _batchavg,
    "sliding_17_11": _sliding,
    "sliding_coefficients": _sliding_coefficients,
    "sliding_batches": _sliding_batches,
    "rechunk_plain": _rechunk(0, False),
    "rechunk_overlap": _rechunk(30, False),
    "rechunk_padded": _rechunk(30, True),
    "rechunk_gap": _rechunk(-20, False),
    "combine_chunks": _combine,
    "sum": lambda s, d: api.sum(cents(s, d)),
    "mean": lambda s, d: api.mean(cents(s, d)).select(F.round("v", 6).alias("v")),
    "length": lambda s, d: api.length(cents(s, d)),
    "axis0_sum": _axis0(api.sum),
    "axis0_mean": _axis0(api.mean),
    "axis0_cumsum": lambda s, d: _entries(api.cumsum(vectors(s, d), block=100).df),
    "axis0_unwrap": lambda s, d: _entries(api.unwrap(api.mapped(vectors(s, d), F.transform("v", lambda x: x * 20)), block=100).df),
    "axis0_batchavg": lambda s, d: _entries(api.batchavg(vectors(s, d), 16, allow_remainder=True).df),
    "axis0_rechunk_padded": _axis0_padded,
    "cumsum": lambda s, d: api.cumsum(cents(s, d), 7, block=1 << 10).df,
    "unwrap": _unwrap,
    "enumerate": lambda s, d: api.enumerate(cents(s, d), 3).df.select("n", "v"),
    "head": lambda s, d: api.head(cents(s, d), 100)[0].df,
    "peek": lambda s, d: api.peek(cents(s, d), 64, 3)[0].df,
    "stop_after": lambda s, d: api.stop_after(cents(s, d), 321).df,
    "start_after": lambda s, d: api.start_after(cents(s, d), 321).df,
    "reverse": lambda s, d: api.reverse(cents(s, d)).df.select("idx", "v"),
    "split": lambda s, d: api.split(api.zipped(cents(s, d), orders(s, d)))[1].df.select("idx", F.col("v1").alias("v")),
    "tee": lambda s, d: api.zipped(*api.tee(cents(s, d))).df,
    "zip_join": lambda s, d: api.zipped(cents(s, d), orders(s, d)).df,
    "zip_reversed": _stored_pair,
    "with_index": _with_index,
    "map_expression": lambda s, d: api.mapped(cents(s, d), F.col("v") * 3 - 1).df,
    "map_fft": _fft,
    "sliceiter": lambda s, d: api.sliceiter(s, 7, 1000),
    "linspace": lambda s, d: api.linspace(s, 1.0, 2.0, 4097).df,
    "concatenate": _concatenate,
    "conv_single": lambda s, d: api.oaconvolve(cents(s, d), [1, -3, 2]).df,
    "conv_long": _long_conv,
    "conv_complex": _complex_conv,
    "sparse_conv_5": lambda s, d: api.oaconvolve(cents(s, d), [1, -3, 2], 5).df,
    "upfirdn_2_3": lambda s, d: api.upfirdn([1, -3, 2], cents(s, d), 2, 3).df,
    "upfirdn_gaps": lambda s, d: api.upfirdn([1, 2], cents(s, d), 5, 1).df,
    "upfirdn_no_flush": lambda s, d: api.upfirdn([1, -3, 2, 4, 5], cents(s, d), 3, 2, flush=False).df,
    "mix": _mix,
    "sosfilt": _filtered(False),
    "sosfiltfilt": _filtered(True),
    "noise": lambda s, d: api.brownian_noise(values(s, d), 1e-2, *BAND, order=4, seed=1, size=1000).df.select("idx", F.round("v", 6).alias("v")),
    "add_brownian_noise": lambda s, d: api.add_brownian_noise(values(s, d), 1e-2, *BAND, order=4, seed=1).df.select("idx", F.round("v", 6).alias("v")),
    "apply_running_sum": _apply,
    "apply_series": _apply_series,
    "chain": _chain,
    "per_entry": _per_entry,
    "chain_no_first_carry": _chain_none,
    "per_entry_no_first_carry": _per_entry_none,
    "binary_skip": _binary_skip,
    "stream_cumsum": _streamed(lambda df: processors.stream_cumsum(df.where("not fin"), 7.0), "v", "bigint"),
    "stream_oaconvolve": _streamed(lambda df: processors.stream_oaconvolve(df, [1, -3, 2], 5, end="fin"), "v", "bigint"),
    "stream_upfirdn": _streamed(lambda df: processors.stream_upfirdn(df, [1, -3, 2], 2, 3, end="fin"), "v", "bigint"),
    "stream_sosfilt": _streamed(lambda df: processors.stream_sosfilt(df.where("not fin"), SOS), "round(v / 100, 3)", "double"),
    "cache_roundtrip": _cache,
    "binary_roundtrip": _binary,
    "store_skip": _store,
    "multihash": _hash,
}

_E = "(select event_id i, cast(round(value * 100) as bigint) v from events)"
_O = "(select o_orderkey i, cast(round(o_totalprice * 100) as bigint) v from orders)"
_T, _P = "6.283185307179586::double", "3.141592653589793::double"


def _rechunk_sql(overlap: int, padded: bool) -> str:
    hop = 100 - overlap
    return f"""with e as {_E}, m as (select count(*) n from e), p as (select n, case when n >= 100 then (n - 100) // {hop} + 1 else 0 end kf from m),
ks as (select unnest(range(kf + case when kf * {hop} < n then 1 else 0 end)) as k from p)
select k as chunk, count(*) as actual_size, {'100::bigint' if padded else 'count(*)'} as n, arg_min(v, i) as first, sum(v)::bigint as total from ks join e on i >= k * {hop} and i < k * {hop} + 100 group by k"""


def _conv_sql(kernel: list[int], factor: int = 1) -> str:
    ker = ", ".join(f"({k},{h})" for k, h in enumerate(kernel))
    return f"with e as {_E}, ker(k, h) as (values {ker}) select i + k * {factor} as idx, sum(v * h)::bigint as v from e cross join ker group by 1"


def _upfirdn_sql(kernel: list[int], up: int, down: int, flush: bool) -> str:
    ker = ", ".join(f"({k},{h})" for k, h in enumerate(kernel))
    tail = len(kernel) if flush else 1
    return f"""with e as {_E}, ker(k, h) as (values {ker}), n as (select count(*) n from e),
g as (select unnest(range(((n - 1) * {up} + {tail} + {down - 1}) // {down})) idx from n),
p as (select (i * {up} + k) // {down} idx, sum(v * h)::bigint y from e cross join ker where (i * {up} + k) % {down} = 0 group by 1)
select g.idx, coalesce(y, 0)::bigint as v from g left join p on g.idx = p.idx"""


#: The embeddings' entries, one a row.
_ENTRIES = "with z as (select vec_id i, p::int p, embedding[p + 1]::double x from embeddings, unnest(range(64)) t(p))"


def _sos_sql(source: str, name: str, sos=SOS) -> str:
    """The sections, one after the other, over source(i, x), as a recursive table name(i, n, l, y, states)."""
    number = lambda v: f"{float(v)!r}::double"
    states = ", ".join(f"z{s}1, z{s}2" for s in range(len(sos)))
    inputs = ["x", *(f"y{s}" for s in range(len(sos)))]
    rows = f"(select i + 1 i, n, l, l[i + 2] x, {states} from {name} where i + 1 < n)"
    after = []
    for s, (b0, b1, b2, _, a1, a2) in zip(range(len(sos)), sos):
        rows = f"(select *, {number(b0)} * {inputs[s]} + z{s}1 y{s} from {rows})"
        after += [f"{number(b1)} * {inputs[s]} - {number(a1)} * y{s} + z{s}2", f"{number(b2)} * {inputs[s]} - {number(a2)} * y{s}"]
    begin = f"select -1::bigint, count(*), list(x order by i), 0::double, {', '.join(['0::double'] * len(after))} from {source}"
    return f"{name}(i, n, l, y, {states}) as ({begin} union all select i, n, l, {inputs[-1]}, {', '.join(after)} from {rows})"


#: The primes of the 64-bit xxHash, and Spark's seed of it.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_SEED, _ONES = 42, (1 << 64) - 1


def _hash_sql(value: str, seed: str) -> str:
    """xxHash of one 64-bit integer; both are expressions of unsigned 128-bit integers."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in _PRIMES)
    low = lambda x: f"(({x}) & {_ONES}::uhugeint)"
    turned = lambda x, n: low(f"({x} << {n}) | ({x} >> {64 - n})")
    times = low(f"{turned(low(f'{value} * {p2}'), 31)} * {p1}")
    mixed = low(f"{turned(f'xor({low(f'{seed} + {p5} + 8::uhugeint')}, {times})', 27)} * {p1} + {p4}")
    return f"(select xor(c, c >> 32) from (select {low(f'xor(b, b >> 29) * {p3}')} c from (select {low(f'xor(a, a >> 33) * {p2}')} b from (select {mixed} a))))"


def _hash(value: int, seed: int) -> int:
    """The same in Python."""
    p1, p2, p3, p4, p5 = _PRIMES
    turned = lambda x, n: (x << n | x >> 64 - n) & _ONES
    x = (turned(seed + p5 + 8 & _ONES ^ turned(value * p2 & _ONES, 31) * p1 & _ONES, 27) * p1 + p4) & _ONES
    x = (x ^ x >> 33) * p2 & _ONES
    x = (x ^ x >> 29) * p3 & _ONES
    return x ^ x >> 32


def _noise_sql() -> str:
    """Tables up to r(i, .., y): the noise of the two queries, with its seed 1."""
    first = [_hash(stream, _hash(1, _SEED)) for stream in (0, 1)]
    uniform = [f"(({_hash_sql('i::uhugeint', f'{f}::uhugeint')} >> 11)::double + 0.5) / 9007199254740992" for f in first]
    std = float(np.sqrt(1e-2**2 * (2 * np.pi) ** 2 / 2 / (1 / BAND[0] - 1 / BAND[1])))
    sos = [[float(x) for x in s] for s in butterworth_bandpass(4, *BAND)]
    return f"""with recursive u as (select event_id i, {uniform[0]} u0, {uniform[1]} u1 from events),
w as (select i, sqrt(-2.0::double * ln(u0)) * cos(2.0::double * {_P} * u1) * {std!r}::double x from u), e as (select i, sum(x) over (order by i rows unbounded preceding) x from w), {_sos_sql('e', 'r', sos)}"""


ORACLES: dict[str, str] = {
    "noise": f"{_noise_sql()} select i as idx, round(y, 6) as v from r where i >= 0",
    "add_brownian_noise": f"{_noise_sql()} select i as idx, round(value + y, 6) as v from r join events on event_id = i where i >= 0",
    "batchavg_16": "with m as (select count(*) n from events) select event_id // 16 as idx, round(avg(value), 6) as v from events, m where event_id < n // 16 * 16 group by 1",
    "sliding_17_11": f"with e as {_E}, m as (select count(*) n from e), ks as (select unnest(range(greatest(0, (n - 17) // 11 + 1))) k from m) select k as window, sum(v)::bigint as total, arg_min(v, i) as first, arg_max(v, i) as last from ks join e on i >= k * 11 and i < k * 11 + 17 group by k",
    "sliding_coefficients": f"with e as {_E}, m as (select count(*) n from e), ks as (select unnest(range(greatest(0, (n - 5) // 3 + 1))) k from m) select k as window, sum(v * case i - k * 3 when 0 then 1 when 1 then 2 when 2 then -3 when 3 then 2 else 1 end)::bigint as total from ks join e on i >= k * 3 and i < k * 3 + 5 group by k",
    "sliding_batches": f"with e as {_E}, m as (select count(*) n from e), ks as (select unnest(range(greatest(0, (n - 5) // 7 + 1))) k from m), w as (select k, sum(v)::bigint t from ks join e on i >= k * 7 and i < k * 7 + 5 group by k) select k // 13 as batch, count(*) as actual_size, 13::bigint as padded_size, sum(t)::bigint as total from w group by 1",
    "rechunk_plain": _rechunk_sql(0, False),
    "rechunk_overlap": _rechunk_sql(30, False),
    "rechunk_padded": _rechunk_sql(30, True),
    "rechunk_gap": _rechunk_sql(-20, False),
    "combine_chunks": f"select i // 192 as chunk, count(*) as actual_size, sum(v)::bigint as total, arg_min(v, i) as first from {_E} group by 1",
    "sum": f"select sum(v)::bigint as v from {_E}",
    "mean": f"select round(avg(v), 6) as v from {_E}",
    "length": "select count(*) as v from events",
    "axis0_sum": "with t as (select unnest(range(1, 65)) i) select (i - 1)::int as pos, round(sum(embedding[i]::double), 6) as x from embeddings, t group by i",
    "axis0_mean": "with t as (select unnest(range(1, 65)) i) select (i - 1)::int as pos, round(avg(embedding[i]::double), 6) as x from embeddings, t group by i",
    "cumsum": f"select i as idx, (7 + sum(v) over (order by i rows unbounded preceding))::bigint as v from {_E}",
    "unwrap": f"""with p as (select event_id i, value - {_T} * floor(value / {_T}) - {_P} v from events), d as (select i, v, v - lag(v) over (order by i) d from p),
w as (select i, v, d, (d + {_P}) - {_T} * floor((d + {_P}) / {_T}) - {_P} m from d),
k as (select i, v, case when d is null or abs(d) < {_P} then 0 when m = -{_P} and d > 0 then {_P} - d else m - d end c from w)
select i as idx, round(v + sum(c) over (order by i rows unbounded preceding), 6) as v from k""",
    "enumerate": f"select i + 3 as n, v from {_E}",
    "head": f"select i as idx, v from {_E} where i < 100",
    "peek": f"select i as idx, v from {_E} where i < 192",
    "stop_after": f"select i as idx, v from {_E} where i < 321",
    "start_after": f"select i - 321 as idx, v from {_E} where i >= 321",
    "reverse": f"select (select count(*) from events) - 1 - i as idx, v from {_E}",
    "split": f"select e.i as idx, o.v from {_E} e join {_O} o on e.i = o.i",
    "tee": f"select i as idx, v as v0, v as v1 from {_E}",
    "zip_join": f"select e.i as idx, e.v as v0, o.v as v1 from {_E} e join {_O} o on e.i = o.i",
    "zip_reversed": f"with z as (select e.i, e.v as v0, o.v as v1 from {_E} e join {_O} o on e.i = o.i) select (select count(*) from z) - 1 - i as idx, v0, v1 from z",
    "with_index": "select row_number() over (order by c_acctbal, c_custkey) - 1 as idx, c_custkey from customer",
    "map_expression": f"select i as idx, v * 3 - 1 as v from {_E}",
    "sliceiter": "select i * 7 as start, least(i * 7 + 7, 1000) as stop from range(143) t(i)",
    "linspace": "select i as idx, 1.0::double + i * (1.0::double / 4096) as v from range(4097) t(i)",
    "concatenate": f"select count(*) as n, arg_min(v, i) as first, arg_max(v, i) as last, (sum(v) filter (i % 7 = 0))::bigint as every_seventh from {_E}",
    "axis0_cumsum": f"{_ENTRIES} select i as idx, p as pos, round(sum(x) over (partition by p order by i rows unbounded preceding), 6) as x from z",
    "axis0_unwrap": f"""{_ENTRIES}, d as (select i, p, 20 * x v, 20 * x - lag(20 * x) over (partition by p order by i) d from z),
w as (select i, p, v, d, (d + {_P}) - {_T} * floor((d + {_P}) / {_T}) - {_P} m from d),
k as (select i, p, v, case when d is null or abs(d) < {_P} then 0 when m = -{_P} and d > 0 then {_P} - d else m - d end c from w)
select i as idx, p as pos, round(v + sum(c) over (partition by p order by i rows unbounded preceding), 6) as x from k""",
    "axis0_batchavg": f"{_ENTRIES}, m as (select count(*) // 64 n from z) select i // 16 as idx, p as pos, round(avg(x), 6) as x from z, m where i < n // 16 * 16 group by 1, 2",
    "axis0_rechunk_padded": f"""{_ENTRIES}, m as (select count(*) // 64 n from z), p as (select n, case when n >= 64 then (n - 64) // 54 + 1 else 0 end kf from m),
ks as (select unnest(range(kf + case when kf * 54 < n then 1 else 0 end)) as k from p)
select k as chunk, count(*) // 64 as actual_size, 64::bigint as n, round(sum(x), 6) as total, 64::bigint as width from ks join z on i >= k * 54 and i < k * 54 + 64 group by k""",
    "map_fft": f"""{_ENTRIES}, k as (select unnest(range(4)) k), f as (select i, k, sum(x * cos({_T} * k * p / 64)) re, sum(x * sin({_T} * k * p / 64)) im from z, k group by 1, 2)
select i as idx, k::int as k, round(re * re + im * im, 5) as p from f""",
    "sosfilt": f"with recursive e as (select event_id i, value x from events), {_sos_sql('e', 'r')} select i as idx, round(y, 3) as v from r where i >= 0",
    "sosfiltfilt": f"""with recursive e as (select event_id i, value x from events), {_sos_sql('e', 'r')}, b as (select n - 1 - i as i, y as x from r where i >= 0), {_sos_sql('b', 'q')}
select n - 1 - i as idx, round(y, 0) as v from q where i >= 0""",
    "chain_no_first_carry": f"select i as idx, 2 * v + 1 as v from {_E}",
    "per_entry_no_first_carry": f"select e.i as idx, 2 * e.v as v0, o.v as v1 from {_E} e join {_O} o on e.i = o.i",
    "binary_skip": f"select row_number() over (order by i) - 1 as idx, v + 2 as v from {_E} where (i // 50) % 4 = 0",
    "conv_single": _conv_sql([1, -3, 2]),
    "conv_long": _conv_sql([(k * 7) % 11 - 5 for k in range(100)]),
    "conv_complex": f"with e as {_E}, ker(k, a, b) as (values (0, 1, 2), (1, 0, -3), (2, 2, 0)) select i + k as idx, sum(v * a - i * b)::double as re, sum(v * b + i * a)::double as im from e cross join ker group by 1",
    "sparse_conv_5": _conv_sql([1, -3, 2], 5),
    "upfirdn_2_3": _upfirdn_sql([1, -3, 2], 2, 3, True),
    "upfirdn_gaps": _upfirdn_sql([1, 2], 5, 1, True),
    "upfirdn_no_flush": _upfirdn_sql([1, -3, 2, 4, 5], 3, 2, False),
    "mix": "select event_id as idx, round(value * cos(event_id * 0.0625::double), 6) as re, round(value * sin(event_id * 0.0625::double), 6) as im from events",
    "apply_running_sum": f"select i as idx, (sum(v) over (order by i rows unbounded preceding))::bigint as v from {_E}",
    "apply_series": "select user_id, event_id as idx, (sum(cast(round(value * 100) as bigint)) over (partition by user_id order by event_id rows unbounded preceding))::bigint as v from events",
    "chain": f"select i as idx, (5 + 2 * sum(v) over (order by i rows unbounded preceding))::bigint as v from {_E}",
    "per_entry": f"select e.i as idx, e.v + 1 as v0, -o.v as v1 from {_E} e join {_O} o on e.i = o.i",
    "stream_cumsum": f"select i as idx, (7 + sum(v) over (order by i rows unbounded preceding))::bigint as v from {_E}",
    "stream_oaconvolve": f"with r as ({_conv_sql([1, -3, 2], 5)}), n as (select max(idx) m from r) select t.i as idx, coalesce(v, 0)::bigint as v from n, unnest(range(m + 1)) t(i) left join r on r.idx = t.i",
    "stream_upfirdn": _upfirdn_sql([1, -3, 2], 2, 3, True),
    "stream_sosfilt": f"with recursive e as (select event_id i, round(value * 100) x from events), {_sos_sql('e', 'r')} select i as idx, round(y / 100, 3) as v from r where i >= 0",
    "cache_roundtrip": f"select i as idx, v * 2 as v from {_E}",
    "binary_roundtrip": f"select i as idx, v from {_E}",
    "store_skip": f"select i as idx, v - 1 as v from {_E} where (i // 50) % 3 = 0",
    "multihash": "select event_id, sha256(unhex(sha256(event_type) || sha256(props))) as h from events",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
