"""What failed on larger tables: by time, by memory, or by a limit of size."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import dsp, models, transforms
from sigspark.functions.windows import window
from sigspark.operators import descriptors, fourier, framing, rhythm, spectral, wholes
from sigspark.operators.arrays import grouped

MODEL = models.Hmm(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.3, 0.1, 0.1, 0.1, 0.4], [0.1, 0.4, 0.2, 0.2, 0.1]]))


def test_sequences_are_drawn_side_by_side(spark):
    def one(n, seed):  # a draw at a time
        rng = np.random.default_rng(seed)
        draw = lambda p: int(min(np.searchsorted(np.cumsum(p), rng.random(), "right"), len(p) - 1))
        states = []
        for t in range(n):
            states.append(draw(MODEL.p_init if t == 0 else MODEL.a[states[-1]]))
        return [(t, s, draw(MODEL.b[s])) for t, s in enumerate(states)]

    began = time.process_time()
    states, symbols = MODEL.generate_many(50, range(4000))
    many = time.process_time() - began
    began = time.process_time()
    for i in range(400):
        assert [(t, *v) for t, v in enumerate(zip(states[i].tolist(), symbols[i].tolist(), strict=True))] == one(50, i)
    assert many < 4 * (time.process_time() - began)  # ten times as many

    keys = spark.range(300).select(F.col("id").cast("string").alias("signal_id"), F.col("id").alias("seed_offset"))
    got = wholes.hmm_generate(keys, MODEL, 20, seed=7).collect()
    assert sorted((int(r.signal_id), r.n, r.state, r.symbol) for r in got) == [(i, *v) for i in range(300) for v in one(20, 7 + i)]


@pytest.fixture(scope="module")
def long_signal(spark):
    x = np.random.default_rng(3).normal(size=200_000)
    return x, spark.createDataFrame([("a", x.tolist())], "signal_id string, samples array<double>").cache()


def test_frames_of_a_long_signal_do_not_carry_it(spark, long_signal):
    x, df = long_signal
    views = np.lib.stride_tricks.sliding_window_view(x, 64)[::32]
    w = window("hanning", 64, True)
    s = framing.frames(df, 64, winsize=64, winstep=32)
    y = views * w
    strict, plain = (y[:, 1:] * y[:, :-1] < 0).sum(1), ((views[:, 1:] < 0) != (views[:, :-1] < 0)).sum(1)
    want = {
        "rms": np.sqrt((views**2).mean(1)), "rms_windowed": np.sqrt((y**2).mean(1)), "energy": (y**2).sum(1), "zcr": plain / 64,
        "zcr_strict": strict, "ezr": np.log10(1 + (y**2).sum(1)) / (strict + 1),
    }
    columns = [descriptors.rms(s).alias("rms"), descriptors.rms(s, True).alias("rms_windowed"), descriptors.energy(s).alias("energy"), descriptors.zcr(s).alias("zcr"), descriptors.zcr(s, rate=False, windowed=True, strict=True).alias("zcr_strict"), descriptors.ezr(s).alias("ezr")]
    got = s.df.select("frame", *columns).orderBy("frame").toPandas()
    for name, v in want.items():
        np.testing.assert_allclose(got[name], v, rtol=1e-9, atol=1e-12)
    windowed = framing.winframes(s).select("frame", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("v")).orderBy("frame").toPandas()
    np.testing.assert_allclose(windowed["v"], y.sum(1), atol=1e-9)
    level = views - views.mean(1, keepdims=True)
    sharp = level - 0.97 * np.hstack([level[:, :1], level[:, :-1]])
    fr = framing.frames(df, 64, winsize=64, winstep=32, dc_removal=True, preemph=0.97).df
    got = fr.select("frame", "energy", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("v")).orderBy("frame").toPandas()
    np.testing.assert_allclose(got[["energy", "v"]].to_numpy().T, [(level**2).sum(1), (sharp**2).sum(1)], rtol=1e-9)


def test_frames_with_missing_samples(spark):
    x = [float(i) for i in range(12)]
    df = spark.createDataFrame([("a", x[:5] + [None] + x[6:]), ("b", None), ("c", x[:3]), ("d", x[:4])], "signal_id string, samples array<double>")
    rows = lambda **o: {(r.signal_id, r.frame): (r.energy, r.x) for r in framing.frames(df, 4, winsize=4, winstep=4, **o).df.collect()}
    assert rows() == {("a", 0): (14.0, x[:4]), ("a", 1): (None, [4.0, None, 6.0, 7.0]), ("a", 2): (366.0, x[8:]), ("d", 0): (14.0, x[:4])}
    assert rows(preemph=0.5)["a", 1] == (None, [2.0, None, None, 4.0])
    assert rows(dc_removal=True)["a", 1] == (None, [None] * 4)


def test_transforms_of_signals_longer_than_the_limit_squared(spark):
    """By more steps at a size with factors (720) and through a chirp (a prime): fft, analytic, stockwell."""
    assert fourier.steps(720, 16) > 0 and fourier.steps(307, 16) == -1 and fourier.steps(256, 256) == 0
    rng = np.random.default_rng(5)
    x = {"a": rng.normal(size=720), "p": rng.normal(size=307)}
    rows = spark.createDataFrame([(s, n, float(v)) for s, c in x.items() for n, v in enumerate(c)], "signal_id string, n bigint, x double").cache()

    def same(df, want):
        for s, w in want.items():
            got = df.where(F.col("signal_id") == s).orderBy("n").toPandas()
            assert got["n"].tolist() == list(range(len(w)))
            np.testing.assert_allclose(got["re"] + 1j * got["im"], w, atol=1e-9)

    there = fourier.fft(fourier.pieces_of(rows, 50), fourier.sizes_of(rows), limit=16)
    same(fourier.rows_of(there), {s: np.fft.fft(c) for s, c in x.items()})
    same(fourier.analytic(rows.where("signal_id = 'a'"), 16), {"a": dsp.hilbert(x["a"])})
    voice = fourier.stockwell(rows.where("signal_id = 'a'"), 3, 3, limit=16)
    same(voice, {"a": transforms.st(x["a"], 3, 3)[0]})


def test_bands_come_one_after_another():
    """What is pooled is that of the whole matrix, in a few times the signal's memory; whole matrices took 54 to 244 times."""
    x, w, opts = np.random.default_rng(1).normal(size=200_001), window("rect", 128, True), {"freqrange": (2, 30), "voices": 4}
    starts = dsp.frame_starts(len(x), 128, 64)
    pwt = {"nbands": 12, "freqrange": (4, 30), "bins_per_octave": 6}

    def squeezed(v, s):
        bands, f = transforms.cwt_each(v, 64, **opts)
        return transforms.pooled_squeezed(((y, transforms.nearest_band(f, transforms.phase_frequency(y[None, :], 64)[0], True)) for y in bands), len(f), s, w, 0.001)

    def squeezed_whole(v, s):
        y, f = transforms.cwt_frames(v, 64, **opts)
        return transforms.pooled(np.sqrt(transforms.synsq(y, f, 64, None, 0.001, 1, True)), s, w)

    def derived(v, s):
        cells, f = transforms.wsst_each(v, 64, scale=None, **opts)
        return transforms.pooled_squeezed(cells, len(f), s, w, 0.001)

    def hht_whole(v, s):
        grid = np.zeros((33, len(v)))
        for y in transforms.emd(v)[0]:
            z = dsp.hilbert(y)
            grid[np.clip(np.rint(transforms.phase_frequency(z[None, :], 64)[0]).astype(int), 0, 32), np.arange(len(v))] += np.abs(z) ** 2
        return np.array([grid[:, a : a + 128] @ w for a in s]) / w.sum()

    for most, each, whole in (
        (16, lambda v, s: transforms.pooled(transforms.cwt_each(v, 64, **opts)[0], s, w), lambda v, s: transforms.pooled(transforms.cwt_frames(v, 64, **opts)[0], s, w)),
        (24, squeezed, squeezed_whole),
        (40, derived, lambda v, s: transforms.pooled(np.sqrt(transforms.wsst(v, 64, scale=None, energy=True, **opts)[0]), s, w)),
        (20, lambda v, s: transforms.pooled(transforms.pwt_each(v, 64, **pwt)[0], s, w), lambda v, s: transforms.pooled(transforms.pwt(v, 64, **pwt)[0], s, w)),
        (30, lambda v, s: transforms.hht(v, 64, s, w, 33)[0], hht_whole),
    ):
        short = dsp.frame_starts(3001, 128, 64)
        np.testing.assert_allclose(each(x[:3001], short), whole(x[:3001], short), atol=1e-12)
        tracemalloc.start()
        assert each(x, starts).shape[0] == len(starts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * x.nbytes, peak / x.nbytes


def test_grouped_holds_plain_numbers(spark):
    """Keys with one value and with many batches of them, a null key and null values; three million values in one row."""
    rng = np.random.default_rng(2)
    sizes = {"a": 1, "b": 25_000, None: 3, "c": 2, "d": 10_000, "e": 1}
    rows = [(k, n, None if (k, n) == ("c", 1) else float(n) / 4) for k, m in sizes.items() for n in rng.permutation(m).tolist()]
    df = spark.createDataFrame(rows, "k string, n long, x double").repartition(3)
    got = {r.k: r.samples for r in grouped(df, "k", "n", "x").collect()}
    assert got == {k: [0.0, None] if k == "c" else [n / 4 for n in range(m)] for k, m in sizes.items()}
    long = grouped(spark.range(3_000_000).select(F.lit("a").alias("k"), "id", (-F.col("id")).cast("double").alias("x")), "k", "id", "x")
    assert "collect_list" not in long._jdf.queryExecution().toString()
    r = long.select(F.size("samples").alias("n"), F.col("samples")[0].alias("first"), F.col("samples")[2_999_999].alias("last")).first()
    assert tuple(r) == (3_000_000, 0.0, -2_999_999.0)


def test_models_are_trained_side_by_side(spark):
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 5, n) for n in (1, 2, 3, 30, 64, 7, 64, *rng.integers(40, 60, 40))]
    began = time.process_time()
    want = [MODEL.train(s) for s in seqs]
    one = time.process_time() - began
    began = time.process_time()
    got = MODEL.train_many(seqs)
    assert time.process_time() - began < one / 2
    df = spark.createDataFrame([(str(i), [float(v) for v in s]) for i, s in enumerate(seqs)], "signal_id string, samples array<double>")
    rows = {int(r.signal_id): r for r in wholes.hmm_train(df, MODEL).collect()}
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        for name in ("p_init", "a", "b"):
            np.testing.assert_allclose(getattr(g, name), getattr(w, name), atol=1e-9)
            np.testing.assert_allclose(rows[i][name], getattr(w, name).ravel(), atol=1e-9)


def test_beats_without_spectra_as_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = {str(i): dsp.clicks(np.arange(0.3 + i / 50, 6, 0.5), 8000, length=48_000) + 1e-3 * rng.normal(size=48_000) for i in range(4)}
    df = spark.createDataFrame([*((s, v.tolist()) for s, v in x.items()), ("short", [1.0] * 100), ("zeros", [0.0] * 9000)], "signal_id string, samples array<double>")
    rows = lambda d: sorted(map(tuple, d.select("signal_id", "bpm", "frame").collect()))
    got = rhythm.beat_track_signals(df, 8000, 512, 256)
    env = rhythm.onset_strength(spectral.spectrogram(df, 8000, winsize=512, winstep=256))
    assert rows(got) == rows(rhythm.beat_track(env)) and len(rows(got)) > 20
    assert "Exchange" not in got._jdf.queryExecution().toString()
    want = env.df.where("signal_id = '0'").orderBy("frame").toPandas()["value"]
    monkeypatch.setattr(rhythm, "BLOCK", 50)  # blocks of frames
    np.testing.assert_allclose(rhythm.envelope_of(x["0"], 512, 256, window("hanning", 512, True)), want, atol=1e-12)


def test_stockwell_frame_by_frame():
    """Equal to pooling whole matrices of bands by samples, in a bounded memory: those of 40,000 samples have 12.8 GB."""
    w, x = window("rect", 128, True), np.random.default_rng(8).normal(size=40_000)
    short, starts = dsp.frame_starts(1501, 128, 64), dsp.frame_starts(len(x), 128, 64)
    v, n = x[:1501], 2048
    want = transforms.pooled(transforms.st(v, 0, 750), short, w)
    for held in (1 << 21, 500):  # in memory, through a file
        np.testing.assert_allclose(list(transforms.st_frames(v, 0, 750, short, w, held=held)), want, atol=1e-12)
    want = transforms.pooled(transforms.fst(np.r_[v, np.zeros(n - 1501)], 3, 900)[:, :1501], short, w)
    np.testing.assert_allclose(list(transforms.fst_frames(v, n, 3, 900, short, w)), want, atol=1e-12)
    tracemalloc.start()
    assert sum(len(r) == 32_769 for r in transforms.fst_frames(x, 65_536, 0, 32_768, starts, w)) == len(starts)
    assert tracemalloc.get_traced_memory()[1] < 1e8
    tracemalloc.stop()
