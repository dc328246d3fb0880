"""Front ends that need a whole signal: each signal is a row and goes through its kernel in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import discrete, dsp, filterbanks, models, pitch, transforms
from ..functions.windows import window as make_window
from ..meta import SpecMeta, Stage
from .arrays import ARRAY, lists, per_frame, per_signal
from .framing import check_frames, default_winsize
from .spectral import KEYS

#: Values of sequences that are made side by side.
VALUES = 1 << 18
ROW = {"frame": T.IntegerType(), "t": T.DoubleType(), "spec": ARRAY}


def _grid(sr: int, winsize: int | None, winstep: int | None, window: str, periodic: bool) -> SpecMeta:
    winsize = winsize or default_winsize(sr)
    winstep = winstep or winsize // 2
    check_frames(winsize, winstep, 0, window, "constant")
    return SpecMeta("frames", sr, winsize, winstep, window, periodic)


def _pooled(signals: DataFrame, base: SpecMeta, kind: str, bands, freq: np.ndarray | None, spectrum: str, pool=None, **options) -> Stage:
    """``bands(x)``: coefficients, bands x samples; pooled on frames inside the kernel, so they never leave it."""
    w = base.win()

    def kernel(x: np.ndarray, row: dict):
        starts = dsp.frame_starts(len(x), base.winsize, base.winstep)
        if not len(starts):
            return
        m = (pool or (lambda x, s: transforms.pooled(bands(x), s, w, spectrum)))(x, starts)
        for j, v in enumerate(m):
            yield j, (base.offset + j * base.winstep + base.winsize / 2) / base.sr, v

    meta = base.child(kind, () if freq is None else freq, spectrum=spectrum, **options)
    return Stage(per_signal(signals, ROW, kernel), meta)


def cqt(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, spectrum: str = "power", **options) -> Stage:
    base = _grid(sr, winsize, winstep, "hanning", True)
    freq = transforms.cqt_frequencies(options.get("nbins", 84), options.get("fmin", 32.703), options.get("bins_per_octave", 12))

    def pool(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return transforms.strength(transforms.cqt(x, sr, starts + base.winsize // 2, **options)[0], spectrum)

    return _pooled(signals, base, "cqt", None, freq, spectrum, pool, **options)


def cwt(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power", freqrange=None, **options) -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    freqrange = freqrange or (max(1, sr // base.winsize), sr // 2)
    grid = transforms.cwt_grid(freqrange, options.get("scale"), options.get("nbands", 84), options.get("voices", 12), options.get("bins_per_octave", 12))
    return _pooled(signals, base, "cwt", lambda x: transforms.cwt_each(x, sr, freqrange=freqrange, **options)[0], grid, spectrum, wavelet=str(options.get("wavelet", "morlet")))


def synsq(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "rect", thresh: float = 0.001, order: int = 1, accumulate: str = "energy", spectrum: str = "power", freqrange=None, **options) -> Stage:
    """Synchrosqueezed wavelets, pooled: energies moved to their bands, or coefficients moved and then measured."""
    base = _grid(sr, winsize, winstep, window, True)
    freqrange = freqrange or (max(1, sr // base.winsize), sr // 2)
    grid = transforms.cwt_grid(freqrange, options.get("scale"), options.get("nbands", 84), options.get("voices", 12))
    w = base.win()

    def pool(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if accumulate == "energy" and spectrum == "power" and order == 1:  # powers add up, so bands come one after another
            bands, f = transforms.cwt_each(x, sr, freqrange=freqrange, **options)
            log = options.get("scale") in ("octave", "logspace", None)
            cells = ((y, transforms.nearest_band(f, transforms.phase_frequency(y[None, :], sr)[0], log)) for y in bands)
            return transforms.pooled_squeezed(cells, len(f), starts, w, thresh)
        y, f = transforms.cwt_frames(x, sr, freqrange=freqrange, **options)
        moved = transforms.synsq(y, f, sr, options.get("scale"), thresh, order, accumulate == "energy")
        if accumulate == "energy":
            return transforms.pooled(np.sqrt(np.maximum(moved, 0)), starts, w, spectrum)
        return transforms.pooled(moved, starts, w, spectrum)

    return _pooled(signals, base, "synsq", None, grid, spectrum, pool)


def wsst(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "rect", accumulate: str = "energy", spectrum: str = "power", freqrange=None, **options) -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    freqrange = freqrange or (33, sr // 2)
    grid = transforms.cwt_grid(freqrange, options.get("scale", "octave"), options.get("nbands", 84), options.get("voices", 12))
    w = base.win()

    def pool(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if accumulate == "energy" and spectrum == "power" and options.get("order", 1) == 1:
            cells, f = transforms.wsst_each(x, sr, freqrange=freqrange, **{k: v for k, v in options.items() if k not in ("thresh", "order")})
            return transforms.pooled_squeezed(cells, len(f), starts, w, options.get("thresh", 0.001))
        moved, _, _ = transforms.wsst(x, sr, freqrange=freqrange, energy=accumulate == "energy", **options)
        return transforms.pooled(np.sqrt(np.maximum(moved, 0)) if accumulate == "energy" else moved, starts, w, spectrum)

    return _pooled(signals, base, "wsst", None, grid, spectrum, pool)


def pwt(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power", **options) -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    return _pooled(signals, base, "pwt", lambda x: transforms.pwt_each(x, sr, **options)[0], None, spectrum)


def st(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power", freqrange=None, factor: float = 1, norm: float = 1) -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    low, high = freqrange or (0, sr // 2)

    def pool(x: np.ndarray, starts: np.ndarray):
        n = len(x)
        return transforms.st_frames(x, int(-(-low * n // sr)), min(int(high * n // sr), n // 2), starts, base.win(), spectrum, factor, norm)

    return _pooled(signals, base, "st", None, None, spectrum, pool)


def fst(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power", freqrange=None) -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    low, high = freqrange or (0, sr // 2)

    def pool(x: np.ndarray, starts: np.ndarray):
        n = max(8, dsp.next_pow2(len(x)))
        return transforms.fst_frames(x, n, int(-(-low * n // sr)), min(int(high * n // sr), n // 2), starts, base.win(), spectrum)

    return _pooled(signals, base, "fst", None, None, spectrum, pool)


def nsgt(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power", **options) -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    return _pooled(signals, base, "nsgt", lambda x: transforms.nsgt_matrix(transforms.nsgt(x, sr, **options)[0], len(x)), None, spectrum)


def nsgt_cells(signals: DataFrame, sr: int, **options) -> DataFrame:
    """(signal_id, band, freq, re, im): cells of different lengths, one row for each band."""

    def kernel(x: np.ndarray, row: dict):
        cells, freq = transforms.nsgt(x, sr, **options)
        for b, (c, f) in enumerate(zip(cells, freq, strict=True)):
            yield b, float(f), c.real, c.imag

    return per_signal(signals, {"band": T.IntegerType(), "freq": T.DoubleType(), "re": ARRAY, "im": ARRAY}, kernel)


def discrete_wavelet(signals: DataFrame, sr: int, kind: str = "dwt", wavelet: str = "sym4", level: int = 5, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power") -> Stage:
    """``dwt``, ``wpt`` or ``swt`` bands, each coefficient held over its samples, pooled on frames; lowest band first."""
    if kind not in ("dwt", "wpt", "swt"):
        raise ValueError("kind must be dwt, wpt or swt")
    base = _grid(sr, winsize, winstep, window, True)

    def bands(x: np.ndarray) -> np.ndarray:
        p = np.r_[x, np.zeros(-len(x) % (1 << level))]
        if kind == "wpt":
            y = discrete.wpt(p, wavelet, level)[1]
        elif kind == "swt":
            a, d = discrete.swt(p, wavelet, level)
            y = np.vstack([a[-1:], d[::-1]])
        else:
            c, n = discrete.dwt(p, wavelet, level)[0], len(p)
            cuts = [0, n >> level, *(n >> j for j in range(level - 1, -1, -1))]
            y = np.array([np.repeat(c[a:b], n // (b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])
        return y[:, : len(x)]

    return _pooled(signals, base, kind, bands, discrete.centres(kind, sr, level), spectrum)


def ewt(signals: DataFrame, sr: int, nbands: int = 5, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power") -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    return _pooled(signals, base, "ewt", lambda x: transforms.ewt(x, sr, nbands)[0], None, spectrum)


def hht(signals: DataFrame, sr: int, nbins: int | None = None, winsize: int | None = None, winstep: int | None = None, window: str = "rect", spectrum: str = "power", **options) -> Stage:
    base = _grid(sr, winsize, winstep, window, True)
    nbins = nbins or base.winsize // 2 + 1
    return _pooled(signals, base, "hht", None, np.arange(nbins) * (sr / 2) / (nbins - 1), spectrum, lambda x, s: transforms.hht(x, sr, s, base.win(), nbins, spectrum, **options)[0])


def cohen(signals: DataFrame, sr: int, kernel: str = "wvd", winsize: int | None = None, winstep: int | None = None, window: str = "hanning", sigma: float = 1.0, smooth: int | None = None, signed: bool = False) -> Stage:
    """Wigner-Ville (``wvd``) or Choi-Williams (``cwd``) distribution at frame centres, cut at zero unless ``signed``."""
    if kernel not in ("wvd", "cwd"):
        raise ValueError("kernel must be wvd or cwd")
    base = _grid(sr, winsize, winstep, window, True)
    u = base.winsize // 8 if smooth is None else smooth

    def pool(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        d, _ = transforms.cohen(x, sr, starts + base.winsize // 2, base.win(), kernel, sigma, u)
        return d if signed else np.maximum(d, 0)

    return _pooled(signals, base, kernel, None, np.arange(base.winsize) * sr / (2 * base.winsize), "power", pool)


def imfs(signals: DataFrame, **options) -> DataFrame:
    """(signal_id, imf, samples): intrinsic mode functions, and the rest as number -1."""

    def kernel(x: np.ndarray, row: dict):
        found, rest = transforms.emd(x, **options)
        yield from enumerate(found)
        yield -1, rest

    return per_signal(signals, {"imf": T.IntegerType(), "samples": ARRAY}, kernel)


def reassign(fr: Stage, mode: str = "all", thresh: float = 0.001, order: int = 1, accumulate: str = "complex", spectrum: str = "power", nfft: int | None = None, targets: bool = False) -> DataFrame:
    """(signal_id, frame, bin, value): spectrum cells moved to their centre of gravity in time and frequency.

    Three transforms of each frame give each cell's target; the sum over targets is a grouped sum, so frames of a long
    signal stay apart. Cells weaker than ``thresh`` do not move.
    ``targets`` gives instead where each cell of a frame would go: arrays of ``freqs`` (of bins) and ``times``.
    """
    from pyspark.sql import functions as F

    if mode not in ("all", "freq", "time") or accumulate not in ("complex", "energy") or order < 1 or thresh < 0:
        raise ValueError("mode must be all, freq or time; accumulate complex or energy; order at least 1; thresh not negative")
    m = fr.meta
    nfft = nfft or m.winsize
    w = m.win()
    dw = (np.roll(w, -1) - np.roll(w, 1)) / 2
    tw = (np.arange(m.winsize) - m.winsize // 2) * w
    k = np.arange(nfft // 2 + 1)
    turn = np.exp(2j * np.pi * k * (m.winsize / 2) / nfft)

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        s = np.fft.rfft(x * w, nfft, axis=1)
        moved = np.abs(s) ** 2 >= thresh**2
        safe = np.where(moved & (s != 0), s, 1)
        f = np.broadcast_to(k * m.sr / nfft, s.shape).copy()
        dt = np.zeros(s.shape)
        if mode != "time":
            f = np.where(moved, f - (np.fft.rfft(x * dw, nfft, axis=1) / safe).imag * m.sr / (2 * np.pi), f)
        if mode != "freq":
            dt = np.where(moved, (np.fft.rfft(x * tw, nfft, axis=1) / safe).real / m.winstep, 0)
        target = np.rint(np.clip(f, 0, m.sr / 2) * nfft / m.sr).astype(int)
        for _ in range(order - 1):
            target = np.take_along_axis(target, target, axis=1)
        a = s * turn if accumulate == "complex" else transforms.strength(s, spectrum)
        return [a.real, np.imag(a) * np.ones(a.shape), target.astype(float), dt]

    cells = per_frame(fr.df, ["x"], {"re": ARRAY, "im": ARRAY, "bin": ARRAY, "shift": ARRAY}, kernel, KEYS[:2])
    if targets:
        return cells.select("signal_id", "frame", F.transform("bin", lambda b: b * m.sr / nfft).alias("freqs"), F.transform("shift", lambda v: (F.col("frame") + v) * m.winstep / m.sr).alias("times"))
    last = cells.groupBy("signal_id").agg(F.max("frame").alias("last"))
    rows = cells.join(last, "signal_id").select("signal_id", "frame", "last", F.explode(F.arrays_zip("re", "im", "bin", "shift")).alias("c"))
    to = F.least(F.greatest(F.bround(F.col("frame") + F.col("c.shift"), 0), F.lit(0)), F.col("last")).cast("int")
    got = rows.select("signal_id", to.alias("frame"), F.col("c.bin").cast("int").alias("bin"), "c.re", "c.im").groupBy("signal_id", "frame", "bin").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    if accumulate == "energy":
        value = F.col("re")
    else:
        p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
        value = p if spectrum == "power" else F.sqrt(p)
    return got.select("signal_id", "frame", "bin", value.alias("value"))


# ---- frames ----


def pitch_frames(fr: Stage, method: str = "ncf", bounds=(50, 400), threshold: float | None = None, **options) -> DataFrame:
    """(signal_id, frame, t, value): a pitch for each frame, 0 where there is none; ``method`` may be a callable."""
    f, default = (method, 0.0) if callable(method) else pitch.METHODS[method]
    th, sr = default if threshold is None else threshold, fr.meta.sr
    return per_frame(fr.df, ["x"], {"value": T.DoubleType()}, lambda x: [np.asarray(f(x, sr, bounds, th, **options), float)], KEYS[:3])


def harmonic_ratio(fr: Stage, bounds=(50, 400)) -> DataFrame:
    sr = fr.meta.sr
    return per_frame(fr.df, ["x"], {"value": T.DoubleType()}, lambda x: [pitch.harmonic_ratio(x, sr, bounds)], KEYS[:3])


def harmonic_ratio_tracked(fr: Stage, fmin: float = 50) -> DataFrame:
    """The largest normalised autocorrelation beyond its first sign change, refined; a frame without a change takes the
    lag of the frame before it, so the frames of a signal go through one kernel in order."""
    from pyspark.sql import functions as F

    m = fr.meta
    w, most = m.win(), min(int(m.sr / fmin), m.winsize - 1)
    got = fr.df.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("frame", "t", "x"))).alias("s"))
    got = got.select("signal_id", F.flatten(F.transform("s", lambda v: v["x"])).alias("samples"), F.transform("s", lambda v: v["frame"]).alias("frames"), F.transform("s", lambda v: v["t"]).alias("ts"))
    winsize = m.winsize

    def kernel(x: np.ndarray, row: dict):
        b = x.reshape(-1, winsize) * w
        r = np.fft.irfft(np.abs(np.fft.rfft(b, 2 * winsize, axis=1)) ** 2, 2 * winsize, axis=1)[:, :winsize]
        energy, low = np.cumsum(b * b, axis=1), 0
        for j in range(len(b)):
            crossed = np.flatnonzero(np.sign(r[j, 2 : most + 1]) * np.sign(r[j, 1:most]) <= 0)
            low = int(crossed[0]) + 1 if len(crossed) else low
            lags = np.arange(low + 1, most)
            value = 0.0
            if len(lags):
                g = r[j, lags] / np.sqrt(r[j, 0] * energy[j, winsize - 1 - lags - 1] + 1e-16)
                i = int(g.argmax())
                value = g[i]
                if 0 < i < len(g) - 1:
                    value -= 0.25 * (g[i - 1] - g[i + 1]) * (g[i + 1] - g[i - 1]) / (2 * (2 * g[i] - g[i + 1] - g[i - 1]) + 1e-16)
            yield row["frames"][j], row["ts"][j], float(value)

    return per_signal(got, {"frame": T.IntegerType(), "t": T.DoubleType(), "value": T.DoubleType()}, kernel, carry=["frames", "ts"])


def harmonic_count(s: Stage, bounds=(27, 4000), count_range=None) -> DataFrame:
    power = (lambda v: v) if s.meta.spectrum == "power" else (lambda v: v * v)
    sr, nfft = s.meta.sr, s.meta.nfft
    return per_frame(s.df, ["spec"], {"value": T.LongType()}, lambda v: [pitch.harmonic_count(power(v), sr, nfft, bounds, count_range)], KEYS[:3])


# ---- signals to signals ----


def map_signal(signals: DataFrame, f, column: str = "samples") -> DataFrame:
    """(signal_id, samples): ``f(samples)`` of each signal."""
    return per_signal(signals, {"samples": ARRAY}, lambda x, row: [(f(x),)], samples=column)


def scales_of(freq, sr: int, wavelet="morlet") -> np.ndarray:
    """The scale of each band of a wavelet front end, in samples."""
    return transforms.centre_of(wavelet)[1] * sr / (2 * np.pi * np.asarray(freq, float))


def viterbi(sequences: DataFrame, prob: np.ndarray, a: np.ndarray, p_init: np.ndarray | None = None, column: str = "samples") -> DataFrame:
    """(signal_id, logp, path): the likeliest states of each sequence of symbols, whose probabilities by state are columns
    of ``prob``."""

    def kernel(x: np.ndarray, row: dict):
        path, logp = models.viterbi(prob[:, x.astype(int)], a, p_init)
        return [(logp, path)]

    return per_signal(sequences, {"logp": T.DoubleType(), "path": ARRAY}, kernel, samples=column)


def hmm_generate(keys: DataFrame, model: models.Hmm, n: int, seed: int = 0) -> DataFrame:
    """(signal_id, n, state, symbol): a sampled sequence for each row of (signal_id, seed_offset), the same on every run.

    Sequences of a batch are drawn side by side, as many at a time as have ``VALUES`` symbols. Keys are dealt out first,
    since a small file of them makes many rows.
    """
    from pyspark.sql import functions as F

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.select("signal_id", F.col("seed_offset").cast("bigint").alias("seed_offset")).repartition(parts, "signal_id")
    kind = rows.schema["signal_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            high = max(1, VALUES // max(n, 1))
            for lo in range(0, b.num_rows, high):
                part = b.slice(lo, high)
                states, symbols = model.generate_many(n, [seed + v for v in part.column(1).to_pylist()])
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(n, dtype=np.int32), part.num_rows)), pa.array(states.ravel().astype(np.int32)), pa.array(symbols.ravel().astype(np.int32))], names=["signal_id", "n", "state", "symbol"])

    return rows.mapInArrow(run, f"signal_id {kind}, n int, state int, symbol int")


def hmm_train(sequences: DataFrame, model: models.Hmm, column: str = "samples", **options) -> DataFrame:
    """(signal_id, p_init, a, b) trained on each sequence of symbols from ``model`` on; matrices by rows.

    Sequences of a batch of like length are trained side by side, as many at a time as have ``VALUES`` symbols.
    """
    wide = sequences.select("signal_id", column)
    kind = wide.schema["signal_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x, ends = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(int), np.cumsum(b.column(1).value_lengths().to_numpy())
            sizes = np.diff(np.r_[0, ends])
            order, lo = np.argsort(-sizes, kind="stable"), 0
            while lo < len(order):
                at = order[lo : lo + max(1, VALUES // max(int(sizes[order[lo]]), 1))]
                made = model.train_many([x[ends[i] - sizes[i] : ends[i]] for i in at], **options)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(lists(np.array([getattr(h, c).ravel() for h in made])) for c in ("p_init", "a", "b"))], names=["signal_id", "p_init", "a", "b"])
                lo += len(at)

    return wide.mapInArrow(run, f"signal_id {kind}, p_init array<double>, a array<double>, b array<double>")


def nmf(s: Stage, k: int, **options) -> DataFrame:
    """(signal_id, component, frame_gain, spectrum): W and H of each signal's spectrogram."""
    from .rhythm import matrices

    nb = s.meta.nbins

    def kernel(x: np.ndarray, row: dict):
        w, h = models.nmf(x.reshape(-1, nb).T, k, **options)
        for c in range(k):
            yield c, h[c], w[:, c]

    return per_signal(matrices(s), {"component": T.IntegerType(), "gains": ARRAY, "spectrum": ARRAY}, kernel)


def hmm_decode(sequences: DataFrame, model: models.Hmm, column: str = "samples") -> DataFrame:
    """(signal_id, logp, path) of each sequence of symbols; the model travels in the closure."""

    def kernel(x: np.ndarray, row: dict):
        path, logp = model.decode(x.astype(int))
        return [(logp, path)]

    return per_signal(sequences, {"logp": T.DoubleType(), "path": ARRAY}, kernel, samples=column)


def hmm_predict(sequences: DataFrame, model: models.Hmm, column: str = "samples") -> DataFrame:
    return per_signal(sequences, {"logp": T.DoubleType()}, lambda x, row: [(model.predict(x.astype(int)),)], samples=column)


def window_values(name: str, n: int, periodic: bool = True) -> np.ndarray:
    return make_window(name, n, periodic)


def bank_rows(bank: filterbanks.FilterBank) -> list[tuple[int, int, float]]:
    b, k = np.nonzero(bank.weights)
    return [(int(i), int(j), float(bank.weights[i, j])) for i, j in zip(b, k, strict=True)]
