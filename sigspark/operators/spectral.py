"""Fourier front end, band spectrograms, cepstra and deltas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp, filterbanks
from ..functions.filterbanks import FilterBank
from ..meta import SpecMeta, Stage
from .arrays import ARRAY, lists, neighbours, own_block, per_frame, with_top
from .framing import check_frames, default_winsize

KEYS = ["signal_id", "frame", "t", "energy"]
FLOATMIN = 2.2250738585072014e-308
#: Frames that a kernel holds at a time.
BLOCK = 4096


def _fourier(meta: SpecMeta, nfft: int) -> Callable[[np.ndarray], np.ndarray]:
    w = meta.win()
    return lambda x: np.fft.rfft(x * w, nfft, axis=1)


def stft(fr: Stage, nfft: int | None = None, spectrum: str = "power", scale: float = 1.0, freqrange: tuple[float, float] | None = None) -> Stage:
    """Short-time Fourier spectrum of frames. A ``freqrange`` is applied in the kernel, so other bins never leave it."""
    nfft = nfft or fr.meta.winsize
    if nfft < fr.meta.winsize:
        raise ValueError("nfft must be at least the window size")
    if spectrum not in ("power", "magnitude"):
        raise ValueError("spectrum must be power or magnitude")
    meta = fr.meta.child("stft", filterbanks.fft_grid(fr.meta.sr, nfft), nfft=nfft, spectrum=spectrum, scale=scale)
    lo, hi = meta.bins(*freqrange) if freqrange else (0, meta.nbins)
    f = _fourier(fr.meta, nfft)

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        c = f(x)[:, lo:hi]
        s = c.real**2 + c.imag**2
        return [(s if spectrum == "power" else np.sqrt(s)) * scale]

    df = per_frame(fr.df, ["x"], {"spec": ARRAY}, kernel, KEYS)
    return Stage(df, meta if (lo, hi) == (0, meta.nbins) else meta.child("stft", meta.freq[lo:hi]))


def stft_complex(fr: Stage, nfft: int | None = None) -> Stage:
    """Coefficients as arrays ``re`` and ``im``; a scale is not applied."""
    nfft = nfft or fr.meta.winsize
    f = _fourier(fr.meta, nfft)

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        c = f(x)
        return [c.real, c.imag]

    meta = fr.meta.child("stft", filterbanks.fft_grid(fr.meta.sr, nfft), nfft=nfft)
    return Stage(per_frame(fr.df, ["x"], {"re": ARRAY, "im": ARRAY}, kernel, KEYS), meta, "re")


def phase(c: Stage) -> DataFrame:
    return c.df.withColumn("phase", F.zip_with("re", "im", lambda a, b: F.atan2(b, a)))


def istft(c: Stage, method: str = "wola", length: int | None = None) -> DataFrame:
    """(signal_id, n, x): frames brought back and summed where they overlap, by a grouped sum over samples.

    Samples whose summed window is under 1e-6 stay as they are; samples before the signal's start are left out.
    """
    if method not in ("wola", "ola"):
        raise ValueError("method must be wola or ola")
    m = c.meta
    w = m.win()

    def kernel(re: np.ndarray, im: np.ndarray) -> list[np.ndarray]:
        y = np.fft.irfft(re + 1j * im, m.nfft, axis=1)[:, : m.winsize]
        return [y * w if method == "wola" else y]

    back = per_frame(c.df, ["re", "im"], {"y": ARRAY}, kernel, ["signal_id", "frame"])
    weight = F.array(*[F.lit(float(v)) for v in (w * w if method == "wola" else w)])
    rows = back.select("signal_id", "frame", F.posexplode(F.arrays_zip("y", weight.alias("w"))).alias("j", "v"))
    rows = rows.select("signal_id", (F.col("frame") * m.winstep + F.col("j") + m.offset).alias("n"), F.col("v.y").alias("num"), F.col("v.w").alias("den"))
    got = rows.groupBy("signal_id", "n").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).where("n >= 0")
    got = got if length is None else got.where(F.col("n") < length)
    return got.select("signal_id", "n", F.when(F.col("den") >= 1e-6, F.try_divide("num", "den")).otherwise(F.col("num")).alias("x"))


def to_db(s: Stage, amin: float = 1e-10, top_db: float = 80) -> Stage:
    """Decibels under the top of each signal, cut ``top_db`` below it."""
    power = s.meta.spectrum == "power"
    df = with_top(s.df)

    def kernel(v: np.ndarray, top: np.ndarray) -> list[np.ndarray]:
        level = lambda a: 10 * np.log10(np.maximum(a if power else a * a, amin))
        return [np.maximum(level(v) - level(top)[:, None], -top_db)]

    return Stage(per_frame(df, ["spec", "__top"], {"spec": ARRAY}, kernel, KEYS), s.meta.child("db"))


def lin_spec(s: Stage, freqrange: tuple[float, float] | None = None, win_norm: bool = False) -> Stage:
    """The bins of a range, twice as strong strictly between 0 and the Nyquist frequency."""
    lo, hi = s.meta.bins(*(freqrange or (0, s.meta.sr // 2)))
    f = s.meta.grid()[lo:hi]
    gain = np.where((f > 0) & (f < s.meta.sr / 2), 2.0, 1.0) * (s.meta.winnorm() if win_norm else 1.0)
    df = per_frame(s.df, ["spec"], {"spec": ARRAY}, lambda v: [v[:, lo:hi] * gain], KEYS)
    return Stage(df, s.meta.child("lin_spec", f))


def band_spec(s: Stage, bank: FilterBank, win_norm: bool = False, kind: str = "band_spec") -> Stage:
    """A filterbank on every frame, as a matrix product over a batch of them."""
    if bank.weights.shape[1] != s.meta.nbins or not np.allclose(bank.grid, s.meta.grid()):
        raise ValueError(f"the filterbank has {bank.weights.shape[1]} bins, the spectrogram {s.meta.nbins}")
    w = np.ascontiguousarray(bank.weights.T) * (s.meta.winnorm() if win_norm else 1.0)
    df = per_frame(s.df, ["spec"], {"spec": ARRAY}, lambda v: [v @ w], KEYS)
    return Stage(df, s.meta.child(kind, bank.freq, bank=bank))


def band_spec_join(s: Stage, bank: FilterBank) -> DataFrame:
    """(signal_id, frame, band, value): the same as a join with the bank's relation, whose size is bands x bins."""
    long = s.df.select("signal_id", "frame", F.posexplode("spec").alias("bin", "v"))
    weights = F.broadcast(bank.relation(s.df.sparkSession))  # one row for each weight: its size does not depend on data
    return long.join(weights, "bin").groupBy("signal_id", "frame", "band").agg(F.sum(F.col("w") * F.col("v")).alias("value"))


def mel_spec(s: Stage, win_norm: bool = True, **design) -> Stage:
    if design.get("scale") == "bark":
        raise ValueError("use bark_spec for the bark scale")
    return band_spec(s, filterbanks.auditory(s.meta.sr, grid=s.meta.grid(), **design), win_norm, "mel_spec")


def bark_spec(s: Stage, win_norm: bool = True, **design) -> Stage:
    if "scale" in design:
        raise ValueError("bark_spec has its own scale")
    return band_spec(s, filterbanks.auditory(s.meta.sr, grid=s.meta.grid(), scale="bark", **design), win_norm, "bark_spec")


def erb_spec(s: Stage, win_norm: bool = True, **design) -> Stage:
    return band_spec(s, filterbanks.gammatone(s.meta.sr, grid=s.meta.grid(), **design), win_norm, "erb_spec")


def chroma(s: Stage, norm: float | None = np.inf, bank: FilterBank | None = None, **design) -> Stage:
    """Pitch classes of each frame, divided by the p-norm; frames of zeros stay."""
    bank = bank or filterbanks.chroma(s.meta.sr, s.meta.grid(), **design)
    w = bank.weights.T

    def kernel(v: np.ndarray) -> list[np.ndarray]:
        return [unit_rows(v @ w, norm)]

    return Stage(per_frame(s.df, ["spec"], {"spec": ARRAY}, kernel, KEYS), s.meta.child("chroma", bank.freq))


def unit_rows(c: np.ndarray, norm: float | None) -> np.ndarray:
    if norm is None:
        return c
    d = np.abs(c).max(1) if np.isinf(norm) else (np.abs(c) ** norm).sum(1) ** (1 / norm)
    return c / np.where(d > 0, d, 1)[:, None]


def tonnetz(c: Stage) -> Stage:
    basis = filterbanks.tonnetz_basis(c.meta.nbins).T
    df = per_frame(c.df, ["spec"], {"spec": ARRAY}, lambda v: [unit_rows(v, 1) @ basis], KEYS)
    return Stage(df, c.meta.child("tonnetz", range(6)))


def spectral_contrast(s: Stage, nbands: int = 6, fmin: float = 200, quantile: float = 0.02, linear: bool = False) -> Stage:
    """Mean of the largest less mean of the smallest magnitudes in each octave band, as logarithms or plainly."""
    if fmin <= 0 or not 0 < quantile < 1 or nbands < 1:
        raise ValueError("need fmin > 0, 0 < quantile < 1 and nbands >= 1")
    edges = np.r_[0.0, fmin * 2.0 ** np.arange(nbands + 1)]
    f, sr = s.meta.grid(), s.meta.sr
    if edges[-2] > sr / 2:
        raise ValueError("frequency band exceeds Nyquist")
    bands = []
    for b in range(nbands + 1):
        at = np.flatnonzero((f >= edges[b]) & (f <= edges[b + 1]))
        if not len(at):
            bands.append((at, 0))
            continue
        first, last = at[0] - (1 if b and at[0] else 0), (len(f) - 1 if b == nbands else at[-1])
        at = np.arange(first, last + 1)
        q = max(round(quantile * len(at)), 1)
        at = at[:-1] if b < nbands and len(at) > 1 else at
        bands.append((at, min(q, len(at))))

    power = s.meta.spectrum == "power"

    def kernel(v: np.ndarray) -> list[np.ndarray]:
        m = np.sqrt(v) if power else v
        out = np.zeros((len(v), nbands + 1))
        for b, (at, q) in enumerate(bands):
            if q:
                o = np.sort(m[:, at], axis=1)
                low, high = o[:, :q].mean(1), o[:, -q:].mean(1)
                out[:, b] = high - low if linear else np.log(high + 1e-6) - np.log(low + 1e-6)
        return [out]

    return Stage(per_frame(s.df, ["spec"], {"spec": ARRAY}, kernel, KEYS), s.meta.child("spectral_contrast", range(nbands + 1)))


def poly_features(s: Stage, order: int = 1) -> Stage:
    """Least-squares polynomial of each spectrum over frequency, highest degree first."""
    if order < 0:
        raise ValueError("order must be at least 0")
    solve = np.linalg.pinv(np.vander(s.meta.grid(), order + 1)).T
    df = per_frame(s.df, ["spec"], {"spec": ARRAY}, lambda v: [v @ solve], KEYS)
    return Stage(df, s.meta.child("poly_features", range(order + 1)))


# ---- cepstra ----

RECTIFIERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"mlog": np.log10, "nlog": np.log, "cubic_root": np.cbrt, "db": lambda v: 10 * np.log10(v)}


def mfcc(s: Stage, ncoeffs: int | None = None, rect: str | Callable = "mlog", dither: bool = False, floor: float | None = None, dct: str = "ortho", lifter: int = 0, lifter_offset: int = 0, first: int = 0, energy: str | None = None, energy_mode: str = "replace", energy_floor: float | None = None, top_db: float | None = None) -> Stage:
    """Cepstral coefficients of a band spectrogram: floor, logarithm, cosine transform, lifter, energy, in one kernel.

    ``top_db`` clips under the largest value of the whole signal, which takes an aggregate over its frames and a join.
    """
    nb = s.meta.nbins
    ncoeffs = ncoeffs or nb // 2
    if not 0 < ncoeffs <= nb - first:
        raise ValueError("ncoeffs must be from 1 to the number of bands")
    if energy_mode not in ("replace", "append", "prepend") or energy not in (None, "raw", "spectrum"):
        raise ValueError("energy must be raw or spectrum, energy_mode replace, append or prepend")
    if energy and energy_mode == "replace" and first:
        raise ValueError("energy replaces coefficient 0, so first must be 0")
    low = floor if floor is not None else (1e-8 if dither else FLOATMIN)
    f = RECTIFIERS[rect] if isinstance(rect, str) else rect
    basis = filterbanks.dct_matrix(nb, dct)[first : first + ncoeffs].T
    if lifter:
        basis = basis * (1 + lifter / 2 * np.sin(np.pi * (first + np.arange(ncoeffs) + lifter_offset) / lifter))
    e_floor = np.finfo(float).eps if energy_floor is None else energy_floor
    df, cols = s.df, ["spec"]
    if energy:
        source = "energy" if energy == "raw" else "__e"
        if energy == "spectrum" and "__e" not in df.columns:
            df = df.withColumn("__e", F.aggregate("spec", F.lit(0.0), lambda a, v: a + v))
        cols.append(source)
    if top_db is not None:
        df = per_frame(df, ["spec"], {"spec": ARRAY}, lambda v: [f(np.maximum(v, low))], [c for c in df.columns if c != "spec"])
        df = with_top(df)
        cols.append("__top")

    def kernel(v: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        r = f(np.maximum(v, low)) if top_db is None else np.maximum(v, more[-1][:, None] - top_db)
        c = r @ basis
        if energy:
            e = np.log(np.maximum(more[0], e_floor))[:, None]
            c = {"replace": lambda: np.hstack([e, c[:, 1:]]), "append": lambda: np.hstack([c, e]), "prepend": lambda: np.hstack([e, c])}[energy_mode]()
        return [c]

    out = per_frame(df, cols, {"spec": ARRAY}, kernel, KEYS)
    n = ncoeffs + (energy is not None and energy_mode != "replace")
    return Stage(out, s.meta.child("mfcc", range(n)))


def gtcc(s: Stage, **options) -> Stage:
    if s.meta.kind != "erb_spec":
        raise ValueError("gammatone cepstra need an ERB spectrogram")
    return mfcc(s, **options)


def delta_weights(length: int) -> np.ndarray:
    if length <= 2 or length % 2 == 0:
        raise ValueError("the delta length must be odd and above 2")
    m = length // 2
    return (m - np.arange(length)) / (np.arange(1, m + 1) ** 2).sum()


def delta(s: Stage, delta_length: int = 9, source: str = "standard") -> Stage:
    """A causal difference filter with zeros before the first frame: a sum of lags over the signal, without Python.

    ``transposed`` runs along the coefficients of each frame.
    """
    b = delta_weights(delta_length)
    if source == "transposed":

        def kernel(v: np.ndarray) -> list[np.ndarray]:
            p = np.hstack([np.zeros((len(v), delta_length - 1)), v])
            return [sum(w * p[:, delta_length - 1 - i : p.shape[1] - i] for i, w in enumerate(b))]

        return Stage(per_frame(s.df, ["spec"], {"spec": ARRAY}, kernel, KEYS), s.meta.child("delta", s.meta.freq))
    if source != "standard":
        raise ValueError("source must be standard or transposed")
    taps = [(i, float(v)) for i, v in enumerate(b) if v]
    df, w = neighbours(s.df, delta_length - 1)
    lagged = df.select("*", *[F.lag("spec", i).over(w).alias(f"__l{i}") if i else F.col("spec").alias("__l0") for i, _ in taps])
    total = None
    for i, v in taps:
        weight = F.lit(v)
        term = F.transform(f"__l{i}", lambda x: x * weight)  # noqa: B023
        more = F.zip_with(total, term, lambda a, c: a + c) if total is not None else term
        total = more if total is None else F.when(F.col(f"__l{i}").isNull(), total).otherwise(more)
    df = own_block(lagged).withColumn("spec", total).drop(*[f"__l{i}" for i, _ in taps])
    return Stage(df, s.meta.child("delta", s.meta.freq))


def delta_delta(s: Stage, **options) -> tuple[Stage, Stage]:
    d = delta(s, **options)
    return d, delta(d, **options)


def cepstrogram(fr: Stage, ncep: int = 4) -> Stage:
    """Real cepstrum, and the spectral envelope and details from its low and high quefrencies."""
    n = fr.meta.winsize
    w = fr.meta.win()
    q = np.arange(n)
    low = (q <= ncep) | (q >= n - ncep)

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        c = np.fft.ifft(np.log(np.maximum(np.abs(np.fft.fft(x * w, axis=1)) ** 2, 1e-16)), axis=1).real
        half = n // 2 + 1
        return [c[:, :half], np.fft.fft(c * low, axis=1).real[:, :half], np.fft.fft(c * ~low, axis=1).real[:, :half]]

    df = per_frame(fr.df, ["x"], {"cepstrum": ARRAY, "envelope": ARRAY, "details": ARRAY}, kernel, KEYS)
    return Stage(df, fr.meta.child("cepstrogram", np.arange(n // 2 + 1) / fr.meta.sr), "cepstrum")


def deconv(s: Stage) -> Stage:
    """Timbre (from the spectrum's magnitude transform) and pitch (from its phase) of each frame."""
    n = s.meta.nbins
    m = dsp.next_pow2(2 * n)

    def kernel(v: np.ndarray) -> list[np.ndarray]:
        f = np.fft.fft(v, m, axis=1)
        a = np.abs(f)
        return [np.fft.ifft(a, axis=1).real[:, :n], np.fft.ifft(f / np.maximum(a, 1e-16), axis=1).real[:, :n]]

    return Stage(per_frame(s.df, ["spec"], {"timbre": ARRAY, "pitch": ARRAY}, kernel, KEYS), s.meta.child("deconv", s.meta.freq), "timbre")


def spectrogram(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "hanning", periodic: bool = True, center: bool = False, pad_mode: str = "constant", preemph: float = 0.0, dc_removal: bool = False, pad_end: bool = False, nfft: int | None = None, spectrum: str = "power", scale: float = 1.0, freqrange: tuple[float, float] | None = None) -> Stage:
    """What ``stft(frames(...))`` gives, in one kernel: frames are views of the signal and never become rows.

    A signal's frames leave in blocks, so a task holds one signal and one block of spectra.
    """
    winsize = winsize or default_winsize(sr)
    winstep = winstep or winsize // 2
    check_frames(winsize, winstep, preemph, window, pad_mode)
    nfft = nfft or winsize
    if nfft < winsize or spectrum not in ("power", "magnitude"):
        raise ValueError("nfft must be at least the window size, and spectrum power or magnitude")
    base = SpecMeta("frames", sr, winsize, winstep, window, periodic, -(winsize // 2) if center else 0)
    meta = base.child("stft", filterbanks.fft_grid(sr, nfft), nfft=nfft, spectrum=spectrum, scale=scale)
    lo, hi = meta.bins(*freqrange) if freqrange else (0, meta.nbins)
    w, offset = base.win(), base.offset

    def spectra(x: np.ndarray):
        n = len(x)
        if center:
            if pad_mode == "reflect" and n <= winsize // 2 or not n:
                return
            x = np.pad(x, winsize // 2, pad_mode)
        elif pad_end and n:
            count = 1 if n <= winsize else 1 + -(-(n - winsize) // winstep)
            x = np.r_[x, np.zeros(max(0, (count - 1) * winstep + winsize - n))]
        f = dsp.framed(x, winsize, winstep)
        for i in range(0, len(f), BLOCK):
            b = f[i : i + BLOCK]
            if dc_removal:
                b = b - b.mean(1, keepdims=True)
            e = np.einsum("ij,ij->i", b, b)
            if preemph:
                b = b - preemph * np.hstack([b[:, :1], b[:, :-1]])
            c = np.fft.rfft(b * w, nfft, axis=1)[:, lo:hi]
            s = c.real**2 + c.imag**2
            k = np.arange(i, i + len(b))
            yield k, (offset + k * winstep + winsize / 2) / sr, e, (s if spectrum == "power" else np.sqrt(s)) * scale

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                v = batch.column(1)[r].values
                for k, t, e, s in spectra(np.zeros(0) if v is None else np.asarray(v.to_numpy(zero_copy_only=False), float)):
                    ids = pa.array([batch.column(0)[r].as_py()] * len(k), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(k.astype(np.int32)), pa.array(t), pa.array(e), lists(s)], names=[*KEYS, "spec"])

    df = signals.select("signal_id", "samples")
    kind = df.schema["signal_id"].dataType.simpleString()
    return Stage(df.mapInArrow(run, f"signal_id {kind}, frame int, t double, energy double, spec array<double>"), meta if (lo, hi) == (0, meta.nbins) else meta.child("stft", meta.freq[lo:hi]))


