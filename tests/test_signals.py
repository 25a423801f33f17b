"""Operators against whole-array versions in numpy, for any partitioning and block size."""

import io
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sigframe import api
from sigframe.functions.design import butterworth_bandpass
from sigframe.operators.iir import run, step_matrix
from sigframe.signal import signal
from sigframe.sources import frames

SOME = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def made(spark, x, partitions=3):
    x = np.asarray(x)
    if np.iscomplexobj(x):
        rows, kind = [(i, (float(v.real), float(v.imag))) for i, v in enumerate(x)], "struct<re:double,im:double>"
    else:
        rows, kind = [(i, v.item()) for i, v in enumerate(x)], "bigint" if x.dtype.kind == "i" else "double"
    return signal(spark.createDataFrame(rows, f"idx bigint, v {kind}").repartition(partitions))


def taken(s):
    return api.concatenate(s)


RNG = np.random.default_rng(42)


def windows_of(x, w, step):
    return [x[i : i + w] for i in range(0, len(x) - w + 1, step)]


@pytest.mark.parametrize("span", [1, 16, 4096])
@pytest.mark.parametrize("n,w,step", [(100, 5, 3), (100, 3, 7), (100, 10, 10), (60, 10, 1), (0, 3, 2), (4, 5, 1), (10, 10, 5)])
def test_sliding_window(spark, n, w, step, span, monkeypatch):
    monkeypatch.setattr("sigframe.operators.windows.SPAN", span)
    x = RNG.standard_normal(n)
    got = [r["v"] for r in api.sliding_window(made(spark, x), w, step).orderBy("window").collect()]
    assert np.allclose(got, windows_of(x, w, step)) if got else not windows_of(x, w, step)


def test_sliding_window_coefficients_batches(spark):
    x, c = RNG.standard_normal(100), [0.1, 0.2, 0.3, 0.2, 0.1]
    want = [w * c for w in windows_of(x, 5, 3)]
    got = api.sliding_window(made(spark, x), c, 3, output_chunksize=13, padding=True).orderBy("batch").collect()
    assert [r["actual_size"] for r in got] == [13, 13, 6]
    flat = np.concatenate([r["windows"] for r in got])
    assert np.allclose(flat[:32], want) and not flat[32:].any()
    whole = api.sliding_window(made(spark, x), c, 3, output_chunksize=13, yield_remainder=False).collect()
    assert len(whole) == 2


@pytest.mark.parametrize("bad", [(0, 1, None), (3, 0, None), (3, 1, 0)])
def test_sliding_window_arguments(spark, bad):
    with pytest.raises(ValueError):
        api.sliding_window(made(spark, np.ones(10)), bad[0], bad[1], bad[2])


@SOME
@given(n=st.integers(0, 60), c=st.integers(1, 12), o=st.integers(-4, 11))
def test_rechunk(spark, n, c, o):
    if o >= c:
        with pytest.raises(ValueError):
            api.rechunk(made(spark, np.arange(n)), c, o)
        return
    x, hop, want, k = np.arange(n), c - o, [], 0
    while k * hop + c <= n:
        want.append(x[k * hop : k * hop + c].tolist())
        k += 1
    if k * hop < n:
        want.append(x[k * hop :].tolist())
    got = [r["v"] for r in api.rechunk(made(spark, x), c, o).orderBy("chunk").collect()]
    assert got == want
    padded = [r["v"] for r in api.rechunk(made(spark, x), c, o, padding=True, yield_remainder=False).orderBy("chunk").collect()]
    assert padded == [w for w in want if len(w) == c]


def test_rechunk_pads_complex(spark):
    got = api.rechunk(made(spark, np.array([1 + 1j, 2j, 3.0])), 2, padding=True).orderBy("chunk").collect()
    assert [tuple(v) for v in got[1]["v"]] == [(3.0, 0.0), (0.0, 0.0)] and got[1]["actual_size"] == 1


def test_batchavg(spark):
    x = np.array([1.0, np.nan, 3.0, 4.0, np.nan, np.nan, 7.0])
    with pytest.raises(ValueError):
        api.batchavg(made(spark, x), 2)
    got = taken(api.batchavg(made(spark, x), 2, allow_remainder=True))
    assert np.array_equal(got, [1.0, 3.5, np.nan], equal_nan=True)
    assert taken(api.batchavg(made(spark, np.arange(1.0, 7)), 2)).tolist() == [1.5, 3.5, 5.5]


def test_reductions(spark):
    x = RNG.standard_normal(50)
    s = made(spark, x)
    assert np.isclose(api.sum(s).first().v, x.sum()) and np.isclose(api.mean(s).first().v, x.mean()) and api.length(s).first().v == 50
    z = made(spark, np.array([1 + 2j, 3 - 5j]))
    assert tuple(api.sum(z).first().v) == (4.0, -3.0) and tuple(api.mean(z).first().v) == (2.0, -1.5)
    none = made(spark, np.zeros(0))
    assert api.sum(none).first().v == 0 and api.mean(none).first().v is None and api.length(none).first().v == 0
    assert np.isnan(api.mean(made(spark, np.array([1.0, np.nan]))).first().v)


@SOME
@given(n=st.integers(1, 80), block=st.integers(1, 30))
def test_scans(spark, n, block):
    x = np.cumsum(np.random.default_rng(n).uniform(-4, 4, n))
    assert np.allclose(taken(api.cumsum(made(spark, x), 2.5, block=block)), np.cumsum(x) + 2.5)
    wrapped = np.angle(np.exp(1j * x))
    assert np.allclose(taken(api.unwrap(made(spark, wrapped), block=block)), np.unwrap(wrapped))


def test_cumsum_complex(spark):
    x = RNG.standard_normal(30) + 1j * RNG.standard_normal(30)
    assert np.allclose(taken(api.cumsum(made(spark, x), 1j, block=7)), np.cumsum(x) + 1j)


def test_blocks_of_blocks(spark, monkeypatch):
    from sigframe.operators import scan

    monkeypatch.setattr(scan, "BLOCKS", 3)
    x = RNG.integers(-9, 9, 200)
    assert taken(api.cumsum(made(spark, x), block=4)).tolist() == np.cumsum(x).tolist()


@pytest.mark.parametrize("n,m,factor,block", [(100, 20, 1, 64), (50, 80, 1, 64), (100, 40, 7, 64), (30, 5, 50, 64), (3, 40, 200, 64), (100, 1, 13, 64), (40, 3, 2, 64)])
def test_oaconvolve(spark, n, m, factor, block):
    x, h = RNG.standard_normal(n), RNG.standard_normal(m)
    sparse = np.zeros((m - 1) * factor + 1)
    sparse[::factor] = h
    got = taken(api.oaconvolve(made(spark, x), h, factor, block=block))
    assert np.allclose(got, np.convolve(x, sparse), rtol=1e-9, atol=1e-11)


def test_oaconvolve_kinds(spark):
    x, h = RNG.standard_normal(60) + 1j * RNG.standard_normal(60), RNG.standard_normal(45) + 1j
    assert np.allclose(taken(api.oaconvolve(made(spark, x), h, block=32)), np.convolve(x, h))
    assert np.allclose(taken(api.oaconvolve(made(spark, x.real), h[:4])), np.convolve(x.real, h[:4]))
    i = taken(api.oaconvolve(made(spark, np.array([1 << 52, 1, -(1 << 52)])), [3, 1]))
    assert i.tolist() == np.convolve([1 << 52, 1, -(1 << 52)], [3, 1]).tolist()
    assert api.oaconvolve(made(spark, x), []).df.count() == 0 and api.oaconvolve(made(spark, np.zeros(0)), [1.0]).df.count() == 0
    for bad in (0, 1.5, True):
        with pytest.raises(ValueError):
            api.oaconvolve(made(spark, x), h, bad)
    with pytest.raises(ValueError):
        api.oaconvolve(made(spark, x), [[1.0]])


def resampled(h, x, up, down, flush=True):
    z = np.zeros((len(x) - 1) * up + 1, np.result_type(x, h))
    z[::up] = x
    return (np.convolve(z, h) if flush else np.convolve(z, h)[: len(z)])[::down]


@pytest.mark.parametrize("n,m,up,down", [(50, 7, 2, 3), (50, 64, 3, 2), (20, 2, 5, 1), (30, 200, 4, 3), (30, 3, 1, 7), (1, 5, 3, 4)])
@pytest.mark.parametrize("flush", [True, False])
def test_upfirdn(spark, n, m, up, down, flush):
    x, h = RNG.standard_normal(n), RNG.standard_normal(m)
    assert np.allclose(taken(api.upfirdn(h, made(spark, x), up, down, flush, block=16)), resampled(h, x, up, down, flush))


SLOW = np.array([[1.0, -1.0, 0.0, 1.0, -2 * r * np.cos(w), r * r] for r, w in ((0.99, 0.1), (0.995, 0.3), (0.999, 0.7))])


def test_sosfilt_carries(spark):
    x = RNG.standard_normal(1050)
    want = run(SLOW, x[None], np.zeros((1, 3, 2)))[0][0]
    got = taken(api.sosfilt(SLOW, made(spark, x), size=100))
    assert abs(got - want).max() < 1e-9 * abs(want).max()
    # Without the carry the same blocks are far off: the filter's memory is longer than a block.
    alone = np.concatenate([run(SLOW, x[None, i : i + 100], np.zeros((1, 3, 2)))[0][0] for i in range(0, 1050, 100)])
    assert abs(alone - want).max() > 0.1 * abs(want).max()
    state = RNG.standard_normal((1, 3, 2))
    end = run(SLOW, np.zeros((1, 50)), state)[1].ravel()
    assert np.allclose(np.linalg.matrix_power(step_matrix(SLOW), 50) @ state.ravel(), end)


def test_sosfiltfilt(spark):
    x = RNG.standard_normal(400)
    once = run(SLOW, x[None], np.zeros((1, 3, 2)))[0]
    want = run(SLOW, once[:, ::-1], np.zeros((1, 3, 2)))[0][0][::-1]
    assert np.allclose(taken(api.sosfiltfilt(SLOW, made(spark, x), size=64)), want, atol=1e-9 * abs(want).max())


def test_sosfilt_complex(spark):
    x = RNG.standard_normal(90) + 1j * RNG.standard_normal(90)
    got = taken(api.sosfilt(SLOW[:1], made(spark, x), size=20))
    assert np.allclose(got.real, run(SLOW[:1], x.real[None], np.zeros((1, 1, 2)))[0][0]) and np.allclose(got.imag, run(SLOW[:1], x.imag[None], np.zeros((1, 1, 2)))[0][0])


def test_butterworth():
    sos = butterworth_bandpass(4, 0.05, 0.1)
    response = lambda f: np.prod([(b0 + b2 * np.exp(-4j * np.pi * f)) / (1 + a1 * np.exp(-2j * np.pi * f) + a2 * np.exp(-4j * np.pi * f)) for b0, _, b2, _, a1, a2 in sos])
    assert np.isclose(abs(response(0.05)), 0.5**0.5) and np.isclose(abs(response(0.1)), 0.5**0.5)
    assert abs(response(0.01)) < 1e-2 and abs(response(0.3)) < 1e-2
    assert len(butterworth_bandpass(50, 0.01, 0.1)) == 50


def test_noise_is_the_same_for_any_dealing(spark):
    s = made(spark, np.zeros(300))
    a = taken(api.brownian_noise(s, 1e-2, 0.02, 0.1, order=3, seed=5, size=64))
    b = taken(api.brownian_noise(s.with_df(s.df.repartition(7)), 1e-2, 0.02, 0.1, order=3, seed=5, size=100))
    assert np.allclose(a, b, atol=1e-12) and a.std() > 0
    assert np.allclose(taken(api.add_brownian_noise(s, 1e-2, 0.02, 0.1, order=3, seed=5)), a, atol=1e-12)


def test_mix(spark):
    x = RNG.standard_normal(40)
    assert np.allclose(taken(api.mix(made(spark, x), 3.0, 20.0)), x * np.exp(2j * np.pi * 3 / 20 * np.arange(40)))
    assert np.allclose(taken(api.mix(made(spark, x * 1j), 3.0, 20.0)), 1j * x * np.exp(2j * np.pi * 3 / 20 * np.arange(40)))


def test_slices(spark):
    x = np.arange(30)
    s = made(spark, x)
    first, rest = api.head(s, 4)
    assert taken(first).tolist() == [0, 1, 2, 3] and taken(rest).tolist() == x.tolist()
    assert taken(api.start_after(s, 25)).tolist() == [25, 26, 27, 28, 29]
    assert taken(api.reverse(s)).tolist() == x[::-1].tolist()
    assert taken(api.linspace(spark, 0, 1, 5)).tolist() == [0, 0.25, 0.5, 0.75, 1] and taken(api.linspace(spark, 3, 4, 1)).tolist() == [3]
    assert [tuple(r) for r in api.sliceiter(spark, 3, 7).collect()] == [(0, 3), (3, 6), (6, 7)]
    a, b = api.split(api.zipped(s, made(spark, x[:10] * 2)))
    assert taken(a).tolist() == x[:10].tolist() and taken(b).tolist() == (x[:10] * 2).tolist()
    one, two = api.tee(s)
    assert taken(one).tolist() == taken(two).tolist()
    with pytest.raises(ValueError):
        api.stop_after(s, -1)


def test_with_index(spark):
    df = spark.range(500).selectExpr("(id * 7919) % 500 as k").repartition(5)
    got = api.with_index(df, ["k"]).collect()
    assert sorted((r["idx"], r["k"]) for r in got) == [(i, i) for i in range(500)]


def test_bodies(spark):
    def running(chunk, carry=0):
        out = np.cumsum(chunk) + carry
        return out, out[-1]

    running.has_carry = True
    s = made(spark, np.arange(1, 26))
    assert taken(api.apply(running, s, 4, "bigint")).tolist() == np.cumsum(np.arange(1, 26)).tolist()

    def numbered(i, chunk):
        return chunk * 0 + i

    numbered.has_counter = True
    assert taken(api.apply(numbered, s, 10, "bigint")).tolist() == [0] * 10 + [1] * 10 + [2] * 5
    both = api.chain(lambda x: 2 * x, running)
    out = api.apply(both, s, 7, "bigint", yield_carry=True)
    assert taken(out).tolist() == (2 * np.cumsum(np.arange(1, 26))).tolist() and "carry" in out.df.columns
    pair = api.apply(api.per_entry(lambda x: x + 1), api.zipped(s, s), 6, "bigint")
    assert taken(pair).tolist() == list(range(2, 27))


def test_frames(spark, tmp_path):
    file = io.BytesIO()
    frames.write_frame([np.arange(6.0).reshape(3, 2), np.array([1j])], file)
    frames.write_frame([np.arange(3, dtype="<i2"), np.array(5)], file)
    file.seek(0)
    one, two = frames.read_frames(file)
    assert one[0].tolist() == [[0, 1], [2, 3], [4, 5]] and one[1].tolist() == [1j] and two[0].dtype == np.dtype("<i2") and two[1].shape == ()
    for torn in (file.getvalue()[:-3], b"TUPLX", file.getvalue() + b"TU"):
        with pytest.raises(frames.TornFrame):
            list(frames.read_frames(io.BytesIO(torn)))
    with pytest.raises(frames.TornFrame):
        list(frames.read_frames(io.BytesIO(file.getvalue()), memory_limit=8))
    z = RNG.standard_normal(50) + 1j
    api.chunks_to_binaryfile(made(spark, z).df, str(tmp_path / "z"), chunk_size=7)
    back = signal(api.binaryfile_to_chunks(spark, str(tmp_path / "z"), "v struct<re:double,im:double>"))
    assert np.allclose(taken(back), z)


def test_store_and_cache(spark, tmp_path):
    s = made(spark, np.arange(40))
    api.chunks_to_store(s, str(tmp_path / "a"))
    assert taken(api.stored(spark, str(tmp_path / "a"), reversed=True)).tolist() == list(range(39, -1, -1))
    with pytest.raises(Exception):
        api.chunks_to_store(s, str(tmp_path / "a"))
    api.array_to_store(spark, str(tmp_path / "b"), np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert api.array_from_store(spark, str(tmp_path / "b")).tolist() == [[1, 2], [3, 4]]
    first = api.cache(s, "x", folder=str(tmp_path / "c"))
    again = api.cache(s.with_df(s.df.selectExpr("idx", "v + 1 as v")), "x", folder=str(tmp_path / "c"))
    assert taken(again).tolist() == taken(first).tolist() == list(range(40)) and first.identifier == again.identifier
    other = api.cache(s.with_df(s.df.selectExpr("idx", "v + 1 as v")), ("x", "2"), folder=str(tmp_path / "c"))
    assert taken(other).tolist() == list(range(1, 41))
    assert api.cache(s, "x", folder="/nowhere", active=False).identifier == first.identifier
    assert len([f for f in os.listdir(tmp_path / "c") if not f.endswith(".tmp")]) == 2


def test_plans_push_down(spark, tmp_path, capsys):
    api.chunks_to_store(made(spark, np.arange(40)), str(tmp_path / "p"))
    two = api.stored(spark, str(tmp_path / "p"))
    api.stop_after(two, 5).df.explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThan(idx,5)" in plan


def test_bodies_without_a_first_carry(spark):
    """Bodies that take a carry and have no default for it get None first."""
    def scale(chunk, carry):
        return chunk * 2, carry

    def add_one(chunk, carry):
        return chunk + 1, carry

    def count(chunk, carry):
        carry = (carry or 0) + 1
        return chunk + 0 * carry, carry

    def running(chunk, carry=0):
        out = np.cumsum(chunk) + carry
        return out, int(out[-1])

    for body in (scale, add_one, count, running):
        body.has_carry = True
    x = made(spark, np.arange(1, 5))
    assert taken(api.apply(api.chain(scale, add_one), x, 2, "long")).tolist() == [3, 5, 7, 9]
    assert taken(api.apply(scale, x, 2, "long")).tolist() == [2, 4, 6, 8]
    assert taken(api.apply(api.chain(count, running), x, 2, "long")).tolist() == [1, 3, 6, 10]
    both = api.zipped(x, made(spark, np.arange(7, 11)))
    a, b = taken(api.apply(api.per_entry(scale, count), both, 2, "long, long"))
    assert a.tolist() == [2, 4, 6, 8] and b.tolist() == [7, 8, 9, 10]
    step, first = api.normalize_bodyfun(scale)
    assert first is None and step(0, np.ones(1), first)[1] is None


def arrays(spark, x, kind="double", partitions=3):
    cells = x.tolist() if not np.iscomplexobj(x) else [[(float(c.real), float(c.imag)) for c in r] for r in x]
    return signal(spark.createDataFrame([*zip(range(len(x)), cells)], f"idx bigint, v {'array<' * (x.ndim - 1)}{kind}{'>' * (x.ndim - 1)}").repartition(partitions))


@pytest.mark.parametrize("shape", [(0, 3), (1, 3), (37, 4), (64, 2, 3)])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_array_scans(spark, shape, block, monkeypatch):
    monkeypatch.setattr("sigframe.operators.arrays.BLOCKS", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, shape)
    got = taken(api.cumsum(arrays(spark, x, "bigint"), 5, block=block))
    assert np.array_equal(got.reshape(shape), np.cumsum(x, axis=0) + 5)
    phase = rng.uniform(-20, 20, shape)
    got = taken(api.unwrap(arrays(spark, phase), block=block))
    assert np.allclose(got.reshape(shape), np.unwrap(phase, axis=0))


def test_array_scan_complex(spark):
    x = np.arange(24).reshape(8, 3) * (1 + 2j)
    got = api.cumsum(arrays(spark, x, "struct<re:double,im:double>"), 1j, block=3).df.orderBy("idx").collect()
    assert np.allclose([[c.re + 1j * c.im for c in r.v] for r in got], np.cumsum(x, axis=0) + 1j)
    with pytest.raises(Exception, match="one shape"):
        api.cumsum(signal(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "idx bigint, v array<double>").coalesce(1))).df.collect()


@pytest.mark.parametrize("shape", [(36, 4), (12, 2, 3)])
def test_array_batchavg(spark, shape):
    x = np.random.default_rng(2).standard_normal(shape)
    x[2:4, 0] = np.nan
    x[6:12, 1] = np.nan
    got = taken(api.batchavg(arrays(spark, x), 6))
    with np.errstate(all="ignore"):
        import warnings

        warnings.simplefilter("ignore")
        want = np.nanmean(x.reshape(shape[0] // 6, 6, *shape[1:]), axis=1)
    assert np.allclose(got, want, equal_nan=True)
    with pytest.raises(ValueError):
        api.batchavg(arrays(spark, x), 5)


@pytest.mark.parametrize("shape", [(10, 3), (5, 2, 2)])
def test_array_rechunk_padded(spark, shape):
    x = np.random.default_rng(3).standard_normal(shape)
    got = api.rechunk(arrays(spark, x), 4, padding=True).orderBy("chunk").collect()
    whole = np.concatenate([np.array(r.v) for r in got])
    assert [r.actual_size for r in got] == [4] * (shape[0] // 4) + [shape[0] % 4] and np.allclose(whole[: len(x)], x) and not whole[len(x) :].any()


def test_rechunk_concatenate(spark):
    from pyspark.sql import functions as F

    got = api.rechunk(made(spark, np.arange(10)), 4, concatenate=F.array_max).orderBy("chunk").collect()
    assert [r.v for r in got] == [3, 7, 9]


FAKE_H5PY = """
import numpy as np


class Dataset:
    def __init__(self, x):
        self.x, self.shape, self.dtype, self.chunks = x, x.shape, x.dtype, (7,)

    def __getitem__(self, at):
        return self.x[at]


class File:
    def __init__(self, path, mode):
        self.all = np.load(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.all.close()

    def __contains__(self, name):
        return name in self.all

    def __getitem__(self, name):
        return Dataset(self.all[name])
"""


def test_hdf5(spark, tmp_path, monkeypatch):
    """With a stand-in for h5py that reads numpy's files: discovery, several datasets, axes, kinds, order."""
    (tmp_path / "h5py.py").write_text(FAKE_H5PY)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    x, y, z = np.arange(20), np.random.default_rng(1).standard_normal((23, 2, 3)), np.arange(5) * 1j
    one, many = str(tmp_path / "one.npz"), str(tmp_path / "many.npz")
    np.savez(one, data=x, other=z)
    np.savez(many, data0=x, data1=y, data3=x)
    assert np.array_equal(taken(api.from_hdf5(spark, one)), x)
    assert np.array_equal(taken(api.from_hdf5(spark, one, reversed=True, chunksize=3)), x[::-1])
    assert np.array_equal(taken(api.from_hdf5(spark, one, "other")), z)
    both = api.from_hdf5(spark, many)
    a, b = taken(both)
    assert np.array_equal(a, x) and np.allclose(b, y[:20]) and both.identifier != api.from_hdf5(spark, many, "data0").identifier
    a, b = taken(api.from_hdf5(spark, many, ["data1", "data0"], reversed=True))
    assert np.allclose(a, y[:20][::-1]) and np.array_equal(b, x[::-1])
    with pytest.raises(ValueError):
        api.from_hdf5(spark, many, chunksize=4)


def test_sliding_window_automatic_batches(spark):
    x = RNG.standard_normal(100)
    got = api.sliding_window(made(spark, x), 1 << 15, 3, output_chunksize="auto").count()
    assert got == 0
    got = api.sliding_window(made(spark, x), 10, 3, output_chunksize="auto").collect()
    assert [r.actual_size for r in got] == [31]
