"""Transforms of signals in rows, against numpy and the one-row front ends."""

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sigspark.functions import dsp, transforms
from sigspark.operators import blocks, fourier, wholes

SIZES = {"a": 360, "b": 97, "c": 1, "d": 256, "e": 194}


@pytest.fixture(scope="module")
def signals():
    r = np.random.default_rng(4)
    return {k: r.normal(size=n) for k, n in SIZES.items()}


@pytest.fixture(scope="module")
def rows(spark, signals):
    data = [(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    random.Random(0).shuffle(data)
    return spark.createDataFrame(data, "signal_id string, n long, x double").cache()


def complexes(df, keys=("signal_id",)):
    got = {}
    for r in df.orderBy(*keys, "n").collect():
        got.setdefault(tuple(r[k] for k in keys), []).append((r["n"], r["re"] + 1j * r["im"]))
    for v in got.values():
        assert [n for n, _ in v] == list(range(len(v)))
    return {k if len(k) > 1 else k[0]: np.array([z for _, z in v]) for k, v in got.items()}


def test_factors():
    for n in (1, 7, 64, 65, 97, 360, 1 << 20, 10**6, 999_983):
        got = fourier.factors(n, 1024)
        if got:
            assert got[0] * got[1] == n and max(got) <= 1024
    assert fourier.factors(999_983, 1024) is None and fourier.factors(1 << 20, 1024) == (1024, 1024)


@pytest.mark.parametrize("limit", [32, 97, 1 << 20])
def test_fourier_and_back(rows, signals, limit):
    """With 32 values a group, 97 and 194 are chirped, the others factored; 97 and more go at once in part."""
    sizes = fourier.sizes_of(rows)
    there = fourier.fft(fourier.pieces_of(rows, 50), sizes, limit=limit)
    got = complexes(fourier.rows_of(there.drop("size")))
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        np.testing.assert_allclose(got[k], np.fft.fft(x), atol=1e-10)
    back = complexes(fourier.rows_of(fourier.fft(there, sizes, True, limit).drop("size")))
    for k, x in signals.items():
        np.testing.assert_allclose(back[k], x, atol=1e-11)


def test_a_million_samples_of_events(spark):
    """2^20 samples made of the events, in groups of at most 2^16 values."""
    values = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("event_id").select("value").toPandas()["value"].to_numpy()
    n = 1 << 20
    x = np.resize(values, n) * np.cos(np.arange(n) / 1000)
    base = spark.read.parquet(f"{SMALL}/events.parquet")
    numbered = blocks.numbered(base.withColumn("k", F.lit("one")), "k", "event_id", "value")
    size = len(values)
    rows = numbered.select("signal_id", F.explode(F.sequence(F.col("n"), F.lit(n - 1), F.lit(size))).alias("n"), "x")
    rows = rows.withColumn("x", F.col("x") * F.cos(F.col("n") / 1000))
    pieces = fourier.fft(fourier.pieces_of(rows), fourier.sizes_of(rows), limit=1 << 16).toPandas()
    got = np.zeros(n, complex)
    for first, re, im in zip(pieces["first"], pieces["re"], pieces["im"], strict=True):
        got[first : first + len(re)] = np.asarray(re) + 1j * np.asarray(im)
    expected = np.fft.fft(x)
    assert np.abs(got - expected).max() < 1e-9 * np.abs(expected).max()


def test_analytic_and_bands(rows, signals):
    got = complexes(fourier.analytic(rows, limit=32))
    for k, x in signals.items():
        np.testing.assert_allclose(got[k], dsp.hilbert(x), atol=1e-10)
    low = complexes(fourier.bands(rows, lambda k, n: [(0, (np.minimum(k, n - k) <= n // 8).astype(float))], limit=32), ("signal_id", "band"))
    for k, x in signals.items():
        f = np.fft.fft(x)
        i = np.arange(len(x))
        np.testing.assert_allclose(low[k, 0], np.fft.ifft(np.where(np.minimum(i, len(x) - i) <= len(x) // 8, f, 0)), atol=1e-10)


def test_stockwell(rows, signals):
    got = complexes(fourier.stockwell(rows.where("signal_id in ('a', 'b')"), 0, 5, limit=32), ("signal_id", "band"))
    for k in ("a", "b"):
        np.testing.assert_allclose(np.array([got[k, b] for b in range(6)]), transforms.st(signals[k], 0, 5), atol=1e-10)


def test_filters_in_blocks(rows, signals):
    taps = np.random.default_rng(1).normal(size=37)
    got = fourier.convolve(rows, taps, size=32).orderBy("signal_id", "n").toPandas()
    for k, x in signals.items():
        np.testing.assert_allclose(got[got.signal_id == k]["y"], dsp.convolve(x, taps)[: len(x)], atol=1e-12)


def matrices(stage):
    got = {}
    for r in stage.df.orderBy("signal_id", "frame").collect():
        got.setdefault(r["signal_id"], []).append((r["frame"], r["t"], r["spec"]))
    for v in got.values():
        assert [f for f, _, _ in v] == list(range(len(v)))
    return {k: (np.array([t for _, t, _ in v]), np.array([s for _, _, s in v])) for k, v in got.items()}


def whole(spark, signals):
    return spark.createDataFrame([(k, 64, x.tolist()) for k, x in signals.items()], "signal_id string, sr int, samples array<double>")


@pytest.mark.parametrize("frames", [3, 256])
def test_constant_q_in_blocks(spark, rows, signals, frames):
    opts = {"fmin": 2.0, "nbins": 24, "bins_per_octave": 6}
    a, b = matrices(fourier.cqt(rows, 64, 32, 16, frames=frames, **opts)), matrices(wholes.cqt(whole(spark, signals), 64, 32, 16, **opts))
    assert a.keys() == b.keys()
    for k in b:
        np.testing.assert_allclose(a[k][1], b[k][1], atol=1e-11)
        np.testing.assert_allclose(a[k][0], b[k][0])


@pytest.mark.parametrize("frames", [3, 256])
def test_wavelets_in_blocks(spark, rows, signals, frames):
    long = {k: x for k, x in signals.items() if len(x) > 90}
    rows = rows.where("signal_id <> 'c'")
    opts = {"voices": 4, "freqrange": (4, 12)}
    a, b = matrices(fourier.cwt(rows, 64, 32, 16, frames=frames, **opts)), matrices(wholes.cwt(whole(spark, long), 64, 32, 16, **opts))
    assert a.keys() == b.keys()
    for k in b:
        np.testing.assert_allclose(a[k][1], b[k][1], atol=1e-8)
    with pytest.raises(ValueError, match="not short"):
        fourier.cwt(rows, 64, 32, 16, voices=4, freqrange=(4, 32))
    with pytest.raises(ValueError, match="shorter"):
        fourier.cwt(rows, 64, 32, 16, voices=4, freqrange=(0.1, 0.2))


@pytest.mark.parametrize(("rate", "frames"), [(1.25, 3), (0.8, 4), (1.0, 100), (2.7, 2)])
def test_stretching_without_seams(rows, signals, rate, frames):
    got = fourier.time_stretch(rows, rate, 64, 32, 8, frames=frames, fan=3).orderBy("signal_id", "n").toPandas()
    for k, x in signals.items():
        own = got[got.signal_id == k]
        expected = dsp.time_stretch(x, rate, 32, 8) if len(x) >= 32 else np.zeros(dsp.half_away(len(x) / rate))
        assert own["n"].tolist() == list(range(len(expected)))
        np.testing.assert_allclose(own["x"], expected, atol=1e-9)
