"""Spark operators: plan shapes, edge cases, audio, streams."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sigspark import catalog
from sigspark.functions import dsp, filterbanks, units
from sigspark.operators import descriptors, framing, rhythm, spectral, wholes
from sigspark.sources import audio
from sigspark.streaming.frames import stream_frames


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, signals):
    return spark.createDataFrame([(k, 16000, [float(v) for v in x]) for k, x in signals.items()], "signal_id string, sr int, samples array<double>")


def test_framed_spectra_do_not_shuffle(spark):
    s = spectral.spectrogram(rows(spark, {"a": np.arange(600)}), 16000, winsize=256)
    p = plan(spectral.mel_spec(s).df)
    assert "Exchange" not in p
    assert p.count("MapInArrow") == 2


def test_short_signals_have_no_frames(spark):
    s = spectral.spectrogram(rows(spark, {"a": np.zeros(10), "b": np.zeros(0), "c": np.ones(256)}), 16000, winsize=256)
    assert [(r.signal_id, r.frame) for r in s.df.collect()] == [("c", 0)]


def test_stft_matches_numpy(spark):
    x = np.random.default_rng(0).normal(size=1000)
    s = spectral.spectrogram(rows(spark, {"a": x}), 16000, winsize=256, winstep=100, nfft=512)
    got = np.array([r.spec for r in s.df.orderBy("frame").collect()])
    ref = np.abs(np.fft.rfft(dsp.framed(x, 256, 100) * s.meta.parent.win(), 512, axis=1)) ** 2
    assert np.allclose(got, ref)
    cut = spectral.spectrogram(rows(spark, {"a": x}), 16000, winsize=256, winstep=100, nfft=512, freqrange=(1000, 2000))
    lo, hi = s.meta.bins(1000, 2000)
    assert np.allclose(np.array([r.spec for r in cut.df.orderBy("frame").collect()]), ref[:, lo:hi])
    assert len(cut.meta.freq) == hi - lo


def test_times_and_duration(spark):
    fr = framing.frames(rows(spark, {"a": np.zeros(1600)}), 16000, winsize=400, winstep=160, center=True)
    t = [r.t for r in fr.df.orderBy("frame").collect()]
    assert np.allclose(t, fr.meta.times(len(t)))
    assert t[0] == 0


@pytest.mark.parametrize("bad", [{"winsize": 0}, {"winsize": 8, "winstep": 9}, {"winsize": 8, "preemph": 1.0}, {"winsize": 8, "window": "x"}, {"winsize": 8, "pad_mode": "x"}])
def test_frame_errors(spark, bad):
    with pytest.raises(ValueError):
        framing.frames(rows(spark, {"a": np.zeros(100)}), 16000, **({"winstep": 4} | bad) if bad.get("winsize") != 0 else framing.check_frames(0, 1, 0, "rect", "edge"))


def test_stage_errors(spark):
    s = spectral.spectrogram(rows(spark, {"a": np.ones(600)}), 16000, winsize=256)
    for f in (
        lambda: spectral.stft(framing.frames(rows(spark, {}), 16000, winsize=256), nfft=128),
        lambda: spectral.band_spec(s, filterbanks.auditory(16000, nfft=1024)),
        lambda: spectral.mel_spec(s, scale="bark"), lambda: spectral.bark_spec(s, scale="htk"), lambda: spectral.gtcc(s),
        lambda: spectral.mfcc(s, energy="raw", first=1), lambda: spectral.delta(s, 4), lambda: descriptors.describe(s, ["x"]), lambda: rhythm.onset_strength(s, 0),
    ):
        with pytest.raises(ValueError):
            f()


def test_stages_keep_to_their_signal(spark):
    a, b = np.random.default_rng(0).normal(size=(2, 2000))
    both = spectral.mfcc(spectral.mel_spec(spectral.spectrogram(rows(spark, {"a": a, "b": b}), 16000, winsize=512)), 13, rect="db", floor=1e-10, top_db=20)
    one = spectral.mfcc(spectral.mel_spec(spectral.spectrogram(rows(spark, {"a": a}), 16000, winsize=512)), 13, rect="db", floor=1e-10, top_db=20)
    get = lambda s: np.array([r.spec for r in s.df.where("signal_id = 'a'").orderBy("frame").collect()])
    assert np.allclose(get(both), get(one))


@pytest.mark.parametrize("front", ["cqt", "cwt", "pwt", "nsgt", "dwt", "swt", "wvd"])
def test_descriptors_follow_any_front_end(spark, front):
    x = rows(spark, {"a": dsp.tone(1000, 16000, 0.1)})
    s = {
        "cqt": lambda: wholes.cqt(x, 16000, 512, fmin=200, nbins=48), "cwt": lambda: wholes.cwt(x, 16000, 512), "pwt": lambda: wholes.pwt(x, 16000, 512, nbands=24, freqrange=(300, 8000)),
        "nsgt": lambda: wholes.nsgt(x, 16000, 512, nbands=24, freqrange=(300, 8000)), "dwt": lambda: wholes.discrete_wavelet(x, 16000, "dwt"), "swt": lambda: wholes.discrete_wavelet(x, 16000, "swt", level=3), "wvd": lambda: wholes.cohen(x, 16000),
    }[front]()
    got = np.array([r.spec for r in s.df.orderBy("frame").collect()])
    assert len(got) and np.isfinite(got).all() and got.min() >= 0
    if s.meta.freq:
        assert got.shape[1] == len(s.meta.freq)
        assert descriptors.describe(s, ["centroid", "entropy"]).count() == len(got)


def test_stages_follow_any_front_end(spark):
    x = rows(spark, {"a": dsp.chirp(300, 3000, 16000, 0.2)})
    s = wholes.cwt(x, 16000, 512, freqrange=(200, 8000))
    for f in (
        lambda: spectral.mfcc(s, 10), lambda: spectral.delta(spectral.mfcc(s, 10), 5), lambda: spectral.lin_spec(s, (500, 2000)), lambda: spectral.to_db(s), lambda: spectral.poly_features(s, 2),
        lambda: spectral.chroma(wholes.cqt(x, 16000, 512, fmin=200, nbins=48), bank=filterbanks.cqt_chroma(200 * 2.0 ** (np.arange(48) / 12), 12)), lambda: rhythm.onset_strength(s), lambda: rhythm.pcen(s),
        lambda: spectral.deconv(s), lambda: spectral.spectral_contrast(s, 3),
    ):
        assert f().df.count() > 2
    assert descriptors.describe_change(s, "flux").count() > 2
    with pytest.raises(Exception, match="energy"):
        spectral.mfcc(s, 10, energy="raw").df.count()


def test_istft_after_masks_adds_up(spark):
    x = np.random.default_rng(2).normal(size=800)
    fr = framing.frames(rows(spark, {"a": x}), 16000, winsize=128, winstep=32)
    y = {r.n: r.x for r in spectral.istft(spectral.stft_complex(fr)).collect()}
    assert max(abs(y[n] - x[n]) for n in range(64, 700)) < 1e-8


def test_hpss_twins_agree(spark):
    s = catalog.spec_e(spark, SMALL)
    h, _ = rhythm.hpss(s, kernel=(7, 5))
    a = {(r.signal_id, r.frame, r.bin): r.value for r in catalog.cells(h, 8).collect()}
    long = rhythm.hpss_long(descriptors.long_view(s), (7, 5), magnitude=False)
    for r in long.collect():
        assert abs(a[r.signal_id, r.frame, r.bin] - r.harmonic) < 1e-6


def test_wait_of_peaks(spark):
    env = spark.createDataFrame([("a", i, 0.0, float(v)) for i, v in enumerate([0, 1, 0, 0, 1, 0, 1, 0])], "signal_id string, frame int, t double, value double")
    got = lambda wait: sorted(r.frame for r in rhythm.peak_pick(env, 1, 1, 1, 1, 0.1, wait).collect())
    assert got(0) == [1, 4, 6] and got(1) == [1, 4, 6] and got(2) == [1, 4]


def test_wav_round_trip(spark, tmp_path):
    x = 0.5 * dsp.tone(220, 8000, 0.1)
    saved = audio.save(spark.createDataFrame([("a", 8000, x.tolist())], "signal_id string, sr int, samples array<double>"), str(tmp_path / "out")).collect()
    back = audio.load(spark, str(tmp_path / "out")).collect()
    assert back[0].sr == 8000 and np.allclose(back[0].samples, x, atol=1 / 32768)
    assert saved[0].path.endswith(".wav")
    assert audio.samplerates(spark, str(tmp_path / "out")).first().sr == 8000
    half = audio.load(spark, str(tmp_path / "out"), sr=4000, norm=True).first()
    assert half.sr == 4000 and half.origin_sr == 8000 and abs(max(map(abs, half.samples)) - 1) < 1e-9


@pytest.mark.parametrize(("kind", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_wav_of_either_byte_order(kind, bits, order):
    import struct

    x = np.array([[0.5, -0.25, 0.125, 0.0], [-1.0, 0.75, 0.0625, -0.5]])
    if kind == 3:
        body = x.T.astype(f"{order}f{bits // 8}").tobytes()
    else:
        whole = np.rint(x.T * 2 ** (bits - 1)).astype(np.int64) + (128 if bits == 8 else 0)
        body = b"".join(int(v).to_bytes(bits // 8, "little" if order == "<" else "big", signed=bits > 8) for v in whole.ravel())
    fmt = struct.pack(f"{order}HHIIHH", kind, 2, 8000, 8000 * bits // 4, bits // 4, bits)
    chunk = lambda name, data: name + struct.pack(f"{order}I", len(data)) + data
    raw = (b"RIFF" if order == "<" else b"RIFX") + b"\0\0\0\0WAVE" + chunk(b"LIST", b"ab") + chunk(b"fmt ", fmt) + chunk(b"data", body)
    rate, got = audio.decode_wav(raw)
    assert rate == 8000 and np.allclose(got, x, atol=2.0**-7)


def test_decoders_of_other_formats(spark, tmp_path):
    (tmp_path / "a.flac").write_bytes(b"fLaC" + bytes([1, 2, 3, 4] * 4))
    with pytest.raises(Exception, match="decoder of flac"):
        audio.load(spark, str(tmp_path)).collect()
    got = audio.load(spark, str(tmp_path), decoders={"flac": lambda raw: (100, np.array([[len(raw), 0.0], [0.0, 2.0]]))}).first()
    assert (got.sr, list(got.samples)) == (100, [10.0, 1.0])


def test_bad_audio_fails(spark, tmp_path):
    (tmp_path / "text.wav").write_bytes(b"not a riff at all")
    with pytest.raises(Exception, match="not an audio file"):
        audio.load(spark, str(tmp_path)).collect()


def test_magic(spark):
    heads = {"wav": b"RIFF\0\0\0\0WAVE", "flac": b"fLaC\0\0\0\0\0\0\0\0", "ogg": b"OggS\0\0\0\0\0\0\0\0", "mp3": b"\xff\xfb\x90\0\0\0\0\0\0\0\0\0", None: b"RIFF\0\0\0\0AVI "}
    df = spark.createDataFrame([(str(k), bytearray(v)) for k, v in heads.items()], "k string, content binary")
    assert {r.k: r.f for r in df.select("k", audio.format_of_magic(F.col("content")).alias("f")).collect()} == {str(k): k for k in heads}


def test_mono_and_peak(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, -4.0]],)], "c array<array<double>>")
    r = df.select(audio.to_mono(F.col("c")).alias("m"), audio.normalize_peak(audio.to_mono(F.col("c"))).alias("p")).first()
    assert r.m == [2.0, -1.0] and r.p == [1.0, -0.5]


def test_streamed_frames_are_batch_frames(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=100)
    src = tmp_path / "in"
    for i, (a, b) in enumerate(((0, 37), (37, 60), (60, 100))):
        spark.createDataFrame([("a", int(n), float(x[n])) for n in range(a, b)], "signal_id string, n long, x double").coalesce(1).write.parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema("signal_id string, n long, x double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream_frames(stream, 16, 8).writeStream.format("memory").queryName("framed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.frame: r.x for r in spark.sql("SELECT * FROM framed").collect()}
    ref = dsp.framed(x, 16, 8)
    assert len(got) == len(ref) and all(np.allclose(got[i], ref[i]) for i in got)


def test_unit_names(spark):
    df = spark.createDataFrame([("A4", 69.0), ("C#3", 49.0), ("Bb2", 46.0), ("what", 60.0)], "note string, n double")
    got = df.select(units.note_to_midi("note").alias("m"), units.midi_to_note("n").alias("name")).collect()
    assert [r.m for r in got] == [69, 49, 46, None]
    assert [r.name for r in got] == ["A4", "C#3", "A#2", "C4"]


def test_notes(spark):
    names = ["A4", "C#-1", "Bb3", " c5 ", "F#♯2", "G", "E!1", "H2", "A4x", "", "B-", "C5-3", None]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", units.note_to_midi("n").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [69, 1, 58, 72, 43, 19, 27, None, None, None, None, None, None]


@pytest.mark.parametrize("block", [4096, 4])
def test_neighbours_in_blocks(spark, monkeypatch, block):
    """Windows over neighbours give the same however small the blocks of frames are."""
    from sigspark.operators import arrays

    monkeypatch.setattr(arrays, "BLOCK", block)
    x = np.random.default_rng(2).normal(size=64 + 8 * 30)
    signals = spark.createDataFrame([("a", 64, x.tolist()), ("b", 64, (x[:90] * 3).tolist())], "signal_id string, sr int, samples array<double>")
    s = spectral.spectrogram(signals, 64, winsize=64, winstep=8)
    v = {k: np.array([r.spec for r in s.df.where(F.col("signal_id") == k).orderBy("frame").collect()]) for k in "ab"}
    flux = descriptors.describe_change(s, "flux").orderBy("signal_id", "frame").collect()
    rise = rhythm.onset_strength(s, lag=2).df.orderBy("signal_id", "frame").collect()
    slope = spectral.delta(s, 9).df.orderBy("signal_id", "frame").collect()
    phase = descriptors.describe_phase(spectral.stft_complex(framing.frames(signals, 64, winsize=64, winstep=8)), "rcd").orderBy("signal_id", "frame").collect()
    for k in "ab":
        m = v[k]
        want = np.r_[0.0, np.sqrt(((m[1:] - m[:-1]) ** 2).sum(1))]
        assert np.allclose([r.value for r in flux if r.signal_id == k], want)
        db = np.maximum(10 * np.log10(np.maximum(m, 1e-10)), 10 * np.log10(m.max()) - 80)
        want = np.r_[np.zeros(min(2, len(m))), np.maximum(db[2:] - db[:-2], 0).mean(1)]
        assert np.allclose([r.value for r in rise if r.signal_id == k], want)
        pad = np.vstack([np.zeros((8, m.shape[1])), m])
        want = sum(w * pad[8 - i : len(pad) - i] for i, w in enumerate(spectral.delta_weights(9)))
        assert np.allclose(np.array([r.spec for r in slope if r.signal_id == k]), want)
        n = [r.value for r in phase if r.signal_id == k]
        assert len(n) == len(m) and n[0] == 0 and (len(n) < 3 or min(n[2:]) > 0)
