"""Spectral descriptors: one value for each frame of any spectrogram. Any set of them is computed in one pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..meta import Stage
from .arrays import neighbours, own_block, per_frame
from .spectral import KEYS

EPS = np.finfo(float).eps


class Frames:
    """A batch of spectra with what several descriptors share, computed once."""

    def __init__(self, s: np.ndarray, f: np.ndarray, power: bool, before: np.ndarray | None = None, energy: np.ndarray | None = None) -> None:
        self.s, self.f, self.is_power, self.before, self.energy_of = s, f, power, before, energy
        self._kept: dict[str, np.ndarray] = {}

    def once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._kept:
            with np.errstate(all="ignore"):
                self._kept[name] = make()
        return self._kept[name]

    @property
    def total(self) -> np.ndarray:
        return self.once("total", lambda: self.s.sum(1))

    @property
    def centroid(self) -> np.ndarray:
        return self.once("centroid", lambda: (self.s @ self.f) / self.total)

    def moment(self, k: int) -> np.ndarray:
        return self.once(f"m{k}", lambda: ((self.f[None, :] - self.centroid[:, None]) ** k * self.s).sum(1) / self.total)

    @property
    def spread(self) -> np.ndarray:
        return self.once("spread", lambda: np.sqrt(self.moment(2)))

    @property
    def power(self) -> np.ndarray:
        return self.once("power", lambda: self.s if self.is_power else self.s**2)

    @property
    def magnitude(self) -> np.ndarray:
        return self.once("magnitude", lambda: np.sqrt(self.s) if self.is_power else self.s)


def _entropy(b: Frames, normalize: bool = True) -> np.ndarray:
    p = b.s / np.where(b.total == 0, 1, b.total)[:, None]
    h = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return h / np.log2(b.s.shape[1]) if normalize else h


def _decrease(b: Frames) -> np.ndarray:
    k = np.arange(1, b.s.shape[1])
    return ((b.s[:, 1:] - b.s[:, :1]) / k).sum(1) / b.s[:, 1:].sum(1)


def _rolloff(b: Frames, threshold: float = 0.95) -> np.ndarray:
    reached = np.cumsum(b.s, axis=1) >= threshold * b.total[:, None]
    return b.f[np.where(reached.any(1), reached.argmax(1), len(b.f) - 1)]


def _slope(b: Frames) -> np.ndarray:
    d = b.f - b.f.mean()
    return (b.s - b.s.mean(1, keepdims=True)) @ d / (d @ d)


def _bandwidth(b: Frames, p: float = 2, normalize: bool = True) -> np.ndarray:
    w = b.s / b.total[:, None] if normalize else b.s
    return (w * np.abs(b.f[None, :] - b.centroid[:, None]) ** p).sum(1) ** (1 / p)


def _energy(b: Frames, log: bool = False, gamma: float = 10) -> np.ndarray:
    return (np.log(1 + gamma * b.power) if log else b.power).mean(1)


def _rms(b: Frames) -> np.ndarray:
    n = b.s.shape[1]
    w = np.ones(n)
    w[0] = 0.5
    if n % 2 == 0:
        w[-1] = 0.5
    return np.sqrt(2 * (b.power @ w) / n**2)


#: Descriptors of a frame alone.
LOCAL: dict[str, Callable[..., np.ndarray]] = {
    "centroid": lambda b: b.centroid,
    "spread": lambda b: b.spread,
    "skewness": lambda b: b.moment(3) / b.spread**3,
    "kurtosis": lambda b: b.moment(4) / b.spread**4,
    "crest": lambda b: b.s.max(1) / (b.total / b.s.shape[1]),
    "decrease": _decrease,
    "entropy": _entropy,
    "flatness": lambda b: np.exp(np.log(b.s + EPS).mean(1)) / b.s.mean(1),
    "rolloff": _rolloff,
    "slope": _slope,
    "bandwidth": _bandwidth,
    "energy": _energy,
    "rms": _rms,
    "hfc": lambda b: b.s @ np.arange(b.s.shape[1]),
    "eef": lambda b, normalize=False: np.sqrt(1 + np.abs(_energy(b) * _entropy(b, normalize))),
    "eer": lambda b, normalize=False, gamma=1: np.sqrt(1 + np.abs(np.log(1 + gamma * _energy(b)) / _entropy(b, normalize))),
    "max": lambda b: b.s.max(1),
    "peak": lambda b: b.f[b.s.argmax(1)],
    "mean": lambda b: b.s.mean(1),
    "var": lambda b: b.s.var(1, ddof=1),
}


def _flux(b: Frames, p: float = 2, positive: bool = False, root: bool = True, mean: bool = False) -> np.ndarray:
    d = b.s - b.before
    d = np.maximum(d, 0) if positive else np.abs(d)
    v = (d**p).sum(1)
    if mean:
        v = v / b.s.shape[1]
    return v ** (1 / p) if root and p != 1 else v


def _novelty(b: Frames, threshold: float = 0, method: str = "sub", data: str = "value") -> np.ndarray:
    with np.errstate(all="ignore"):
        ratio = b.s / (b.before + 1e-16)
        terms = {
            "sub": lambda: b.s - b.before,
            "entropy": lambda: np.log(ratio + 1e-16),
            "kl": lambda: b.s * np.log(ratio + 1e-16),
            "is": lambda: ratio - np.log(ratio + 1e-16) - 1,
        }[method]()
    over = terms > threshold
    return over.sum(1).astype(float) if data == "number" else np.where(over, terms, 0).sum(1)


def _broadband(b: Frames, threshold: float = 0) -> np.ndarray:
    with np.errstate(all="ignore"):
        return (10 * np.log10(b.s / b.before) > threshold).sum(1).astype(float)


def _side(square: bool) -> Callable[..., np.ndarray]:
    def f(b: Frames, positive: bool = False) -> np.ndarray:
        d = b.s - b.before
        d = np.maximum(d, 0) if positive else d
        return (d * d).sum(1) if square else np.abs(d).sum(1)

    return f


def _mkl(b: Frames, mean: bool = False) -> np.ndarray:
    v = np.log(1 + b.s / (b.before + 1e-16))
    return v.mean(1) if mean else v.sum(1)


#: Descriptors of a frame and the one ``step`` before it; 0 where there is none.
DIFFERENCE: dict[str, Callable[..., np.ndarray]] = {"flux": _flux, "sd": _side(False), "sf": _side(True), "mkl": _mkl, "broadband": _broadband, "novelty": _novelty}


def describe(s: Stage, names: list[str], options: dict[str, dict] | None = None) -> DataFrame:
    """(signal_id, frame, t, one column for each name): descriptors of frames alone, in one pass over the spectra."""
    options = options or {}
    unknown = set(names) - set(LOCAL)
    if unknown:
        raise ValueError(f"unknown descriptors {sorted(unknown)}; known: {sorted(LOCAL)}")
    f, power = s.meta.grid(), s.meta.spectrum == "power"

    def kernel(v: np.ndarray) -> list[np.ndarray]:
        b = Frames(v, f, power)
        with np.errstate(all="ignore"):
            return [np.asarray(LOCAL[n](b, **options.get(n, {})), float) for n in names]

    return per_frame(s.df, ["spec"], {n: T.DoubleType() for n in names}, kernel, KEYS[:3])


def describe_change(s: Stage, name: str, step: int = 1, **options) -> DataFrame:
    """(signal_id, frame, t, value): a descriptor of change. The spectrum before comes by ``lag`` among neighbours."""
    if step < 1:
        raise ValueError("step must be at least 1")
    df, w = neighbours(s.df, step)
    df = own_block(df.withColumn("__before", F.lag("spec", step).over(w))).withColumn("__first", F.col("__before").isNull())
    df = df.withColumn("__before", F.coalesce("__before", "spec"))
    f, power, kernel_of = s.meta.grid(), s.meta.spectrum == "power", DIFFERENCE[name]

    def kernel(v: np.ndarray, before: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        return [np.where(first.astype(bool), 0.0, kernel_of(Frames(v, f, power, before), **options))]

    return per_frame(df, ["spec", "__before", "__first"], {"value": T.DoubleType()}, kernel, KEYS[:3])


PHASE = ("pd", "wpd", "nwpd", "cd", "rcd")


def describe_phase(c: Stage, name: str) -> DataFrame:
    """Descriptors of phase and complex change, from coefficients ``re``, ``im`` and the two frames before."""
    if name not in PHASE:
        raise ValueError(f"name must be one of {PHASE}")
    df, w = neighbours(c.df, 2)
    df = df.withColumns({f"{a}{k}": F.coalesce(F.lag(a, k).over(w), F.col(a)) for k in (1, 2) for a in ("re", "im")})
    # frames with none or one before them; one of a later block has two
    df = own_block(df.withColumn("__n", F.row_number().over(w)))

    def kernel(re, im, re1, im1, re2, im2, n) -> list[np.ndarray]:
        z, z1, z2 = re + 1j * im, re1 + 1j * im1, re2 + 1j * im2
        m, p, p1, p2 = np.abs(z), np.angle(z), np.angle(z1), np.angle(z2)
        if name in ("pd", "wpd", "nwpd"):
            d = np.abs(p - 2 * p1 + p2)
            v = d.mean(1) if name == "pd" else (m * d).mean(1)
            if name == "nwpd":
                v = v / np.maximum(m.mean(1), np.finfo(float).tiny)
            return [np.where(n <= 2, 0.0, v)]
        guess = np.where((n >= 3)[:, None], np.abs(z1) * np.exp(1j * (2 * p1 - p2)), 0)
        d = np.abs(z - guess)
        if name == "rcd":
            d = np.where(m > np.abs(z1), d, 0)
        return [np.where(n <= 1, 0.0, d.sum(1))]

    return per_frame(df, ["re", "im", "re1", "im1", "re2", "im2", "__n"], {"value": T.DoubleType()}, kernel, KEYS[:3])


# ---- native twins on the long view: for SQL users, and where a spectrum is wider than a row should be ----


def long_view(s: Stage) -> DataFrame:
    """(signal_id, frame, bin, freq, value)."""
    f = F.array(*[F.lit(float(v)) for v in s.meta.freq])
    rows = s.df.select("signal_id", "frame", F.posexplode(F.arrays_zip("spec", f.alias("freq"))).alias("bin", "v"))
    return rows.select("signal_id", "frame", "bin", F.col("v.freq").alias("freq"), F.col("v.spec").alias("value"))


def centroid_long(cells: DataFrame) -> DataFrame:
    return cells.groupBy("signal_id", "frame").agg(F.try_divide(F.sum(F.col("freq") * F.col("value")), F.sum("value")).alias("centroid"))


def slope_long(cells: DataFrame) -> DataFrame:
    return cells.groupBy("signal_id", "frame").agg(F.regr_slope("value", "freq").alias("slope"))


# ---- frames in time ----


def rms(fr: Stage, windowed: bool = False) -> Column:
    return F.sqrt(_square_sum(fr, windowed) / F.size("x"))


def energy(fr: Stage, windowed: bool = True) -> Column:
    return _square_sum(fr, windowed)


def _square_sum(fr: Stage, windowed: bool) -> Column:
    return F.aggregate(_samples(fr, windowed), F.lit(0.0), lambda a, v: a + v * v)


def _samples(fr: Stage, windowed: bool) -> Column:
    if not windowed:
        return F.col("x")
    w = F.array(*[F.lit(float(v)) for v in fr.meta.win()])
    return F.zip_with("x", w, lambda a, b: a * b)


def zcr(fr: Stage, threshold: float = 1e-10, rate: bool = True, windowed: bool = False, strict: bool = False) -> Column:
    """Changes of sign, by the number of samples; samples within the threshold are zero, and zero is positive.

    ``strict`` counts products below zero instead.
    """
    x = F.transform(_samples(fr, windowed), lambda v: F.when(F.abs(v) <= threshold, F.lit(0.0)).otherwise(v))
    pairs = F.zip_with(F.slice(x, 1, fr.meta.winsize - 1), F.slice(x, 2, fr.meta.winsize - 1), lambda a, b: (a * b < 0) if strict else ((a < 0) != (b < 0)))
    n = F.size(F.filter(pairs, lambda p: p)).cast("double")
    return n / fr.meta.winsize if rate else n


def zero_crossings(x: Column, threshold: float = 1e-10) -> Column:
    """Whether the sign changed at each sample; false at the first."""
    z = F.transform(x, lambda v: F.when(F.abs(v) <= threshold, F.lit(0.0)).otherwise(v))
    return F.transform(z, lambda v, i: F.when(i == 0, False).otherwise((v < 0) != (F.element_at(z, F.greatest(i, F.lit(1))) < 0)))


def ezr(fr: Stage, gamma: float = 1) -> Column:
    """Energy by zero crossings."""
    return F.log10(1 + gamma * energy(fr, True)) / (zcr(fr, rate=False, windowed=True, strict=True) + 1)


def rms_spec(s: Stage) -> Column:
    """The RMS of a frame from its one-sided spectrum."""
    f, nb = s.meta.grid(), s.meta.nbins
    g = F.array(*[F.lit(2.0 if 0 < v < s.meta.sr / 2 else 1.0) for v in f])
    p = F.zip_with("spec", g, lambda v, w: w * (v if s.meta.spectrum == "power" else v * v))
    return F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, v: a + v)) / (2 * (nb - 1))
