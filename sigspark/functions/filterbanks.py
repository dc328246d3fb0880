"""Filterbanks: small driver-side matrices of bands by bins, which travel to executors in a closure or as a relation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import scales
from .windows import WINDOWS

STYLES = ("triangular", "etsi", "point", "rect", "hanning", "hamming", "blackman", "bohman", "kaiser", "gauss")
NORMS = ("area", "bandwidth", "none")


@dataclass(frozen=True)
class FilterBank:
    """``weights`` (bands x bins), centre ``freq`` and ``bandwidth`` of bands, ``grid`` of bins."""

    weights: np.ndarray
    freq: np.ndarray
    bandwidth: np.ndarray
    grid: np.ndarray
    sr: int
    scale: str = ""
    norm: str = "none"
    freqrange: tuple[float, float] = (0, 0)
    extra: dict = field(default_factory=dict)

    @property
    def nbands(self) -> int:
        return len(self.weights)

    def relation(self, spark: SparkSession) -> DataFrame:
        """(band, bin, w) of the weights that are not zero."""
        b, k = np.nonzero(self.weights)
        return spark.createDataFrame([(int(i), int(j), float(self.weights[i, j])) for i, j in zip(b, k, strict=True)], "band int, bin int, w double")


def fft_grid(sr: int, nfft: int) -> np.ndarray:
    return np.arange(nfft // 2 + 1) * (sr / nfft)


def _normalised(w: np.ndarray, norm: str, bw: np.ndarray) -> np.ndarray:
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}, got {norm!r}")
    if norm == "none":
        return w
    d = w.sum(1) if norm == "area" else bw / 2
    return w / np.where(d == 0, 1, d)[:, None]


def _check_range(freqrange, sr: int) -> tuple[float, float]:
    low, high = freqrange
    if not 0 <= low < high <= sr // 2:
        raise ValueError(f"freqrange must satisfy 0 <= low < high <= sr/2, got {freqrange} with sr = {sr}")
    return low, high


def auditory(sr: int, nfft: int = 512, nbands: int = 26, scale: str = "htk", norm: str = "bandwidth", domain: str = "linear", freqrange=None, style: str = "triangular", bins_per_octave: int = 12, grid: np.ndarray | None = None) -> FilterBank:
    """Bands between edges that are even on ``scale``; triangles, or another ``style`` laid on the nearest bins.

    A triangle rises over the bins from the first above its lower edge to before the first above its centre and falls from
    there on; ``domain='warped'`` interpolates in the coordinate of the scale.
    """
    freqrange = freqrange or (0, sr // 2)
    grid = fft_grid(sr, nfft) if grid is None else np.asarray(grid, float)
    low, high = _check_range(freqrange, sr)
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}, got {style!r}")
    if domain not in ("linear", "warped"):
        raise ValueError("domain must be linear or warped")
    edges = scales.band_edges(scale, low, high, nbands, bins_per_octave)
    if edges[-2] > grid[-1] * (1 + 4 * np.finfo(float).eps):
        raise ValueError("the frequency grid does not reach the last band centre; check freqrange")
    bw = edges[2:] - edges[:-2]
    w = np.zeros((nbands, len(grid)))
    if style != "triangular":
        if domain != "linear":
            raise ValueError("window styles are designed in the linear domain only")
        near = np.abs(grid[None, :] - edges[:, None]).argmin(1)
        for b in range(nbands):
            w[b] = _styled(style, len(grid), *near[b : b + 3])
    else:
        first = np.searchsorted(grid, edges, "right")
        first[-1] = min(first[-1], len(grid) - 1)
        x, e = (grid, edges) if domain == "linear" else (scales.warp(scale, grid, bins_per_octave), scales.warp(scale, edges, bins_per_octave))
        for b in range(nbands):
            up, down = slice(first[b], first[b + 1]), slice(first[b + 1], first[b + 2])
            w[b, up] = (x[up] - e[b]) / (e[b + 1] - e[b])
            w[b, down] = (e[b + 2] - x[down]) / (e[b + 2] - e[b + 1])
    return FilterBank(_normalised(w, norm, bw), edges[1:-1], bw, grid, sr, scale, norm, (low, high))


def _styled(style: str, n: int, left: int, mid: int, right: int) -> np.ndarray:
    """Two half windows around ``mid``."""
    out = np.zeros(n)
    if style == "point":
        out[mid] = 1
    elif style == "rect":
        out[left : right + 1] = 1
    elif style == "etsi":
        if mid > left:
            out[left : mid + 1] = np.arange(mid - left + 1) / (mid - left)
        if right > mid:
            out[mid + 1 : right + 1] = np.arange(right - mid - 1, -1, -1) / (right - mid)
    else:
        shape = WINDOWS[style]
        if mid > left:
            out[left : mid + 1] = shape(2 * (mid - left) + 1)[: mid - left + 1]
        if right > mid:
            out[mid + 1 : right + 1] = shape(2 * (right - mid) + 1)[right - mid + 1 :]
    return out


def gammatone(sr: int, nfft: int = 512, nbands: int = 26, norm: str = "bandwidth", freqrange=None, grid: np.ndarray | None = None) -> FilterBank:
    """Magnitude responses of fourth-order gammatone filters, centres even on the ERB scale with both ends of the range."""
    freqrange = freqrange or (0, round(sr / 2))
    grid = fft_grid(sr, nfft) if grid is None else np.asarray(grid, float)
    low, high = _check_range(freqrange, sr)
    k = np.log(10) * 1000 / (24.673 * 4.368)
    e = np.linspace(k * np.log10(1 + ERB_S * low), k * np.log10(1 + ERB_S * high), nbands)
    cf = (10 ** (e / k) - 1) / ERB_S
    w = np.abs(_gammatone_response(cf, grid, sr))
    w[:, (grid > 8 * np.finfo(float).eps * sr / 2) & (grid < sr / 2 * (1 - 8 * np.finfo(float).eps))] *= 2
    bw = 1.019 * 24.7 * (0.00437 * cf + 1)
    return FilterBank(_normalised(w, norm, bw), cf, bw, grid, sr, "erb", norm, (low, high))


ERB_S = 0.004368


def _gammatone_response(cf: np.ndarray, grid: np.ndarray, sr: int) -> np.ndarray:
    """Four second-order sections that share their poles; the zeros are Slaney's, and the gain is one at the centre."""
    t, w0 = 1 / sr, 2 * np.pi * cf / sr
    decay = np.exp(-2 * np.pi * 1.019 * (cf / 9.26449 + 24.7) * t)
    zeros = [s * np.sqrt(3 + q * 2**1.5) for q in (1, -1) for s in (1, -1)]

    def response(z: np.ndarray) -> np.ndarray:
        h = np.ones(np.broadcast(decay[:, None], z).shape, complex)
        poles = 1 - 2 * (decay * np.cos(w0))[:, None] * z + (decay**2)[:, None] * z * z
        for r in zeros:
            h *= (t - (t * decay * (np.cos(w0) + r * np.sin(w0)))[:, None] * z) / poles
        return h

    gain = np.abs(response(np.exp(-1j * w0)[:, None]))
    return response(np.exp(-2j * np.pi * grid / sr)[None, :]) / gain


def etsi(sr: int, nfft: int, nbands: int = 23, freqrange=None) -> FilterBank:
    """Triangles between rounded bins of even mel edges, rising from one step above zero."""
    low, high = _check_range(freqrange or (64, sr // 2), sr)
    edges = scales.band_edges("htk", low, high, nbands)
    b = np.rint(edges * nfft / sr).astype(int)
    w, grid = np.zeros((nbands, nfft // 2 + 1)), fft_grid(sr, nfft)
    for m in range(nbands):
        a, c, e = b[m : m + 3]
        i = np.arange(a, c + 1)
        w[m, i] = (i - a + 1) / (c - a + 1)
        i = np.arange(c + 1, min(e, nfft // 2) + 1)
        w[m, i] = 1 - (i - c) / (e - c + 1)
    return FilterBank(w, edges[1:-1], edges[2:] - edges[:-2], grid, sr, "htk", "none", (low, high))


def psf(sr: int, nfft: int, nbands: int = 26, freqrange=None) -> FilterBank:
    """Plain triangles between floored bins of even mel edges."""
    low, high = _check_range(freqrange or (0, sr // 2), sr)
    edges = scales.band_edges("htk", low, high, nbands)
    b = np.floor((nfft + 1) * edges / sr).astype(int)
    w = np.zeros((nbands, nfft // 2 + 1))
    for m in range(nbands):
        a, c, e = b[m : m + 3]
        i = np.arange(a, c)
        w[m, i] = (i - a) / max(c - a, 1)
        i = np.arange(c, min(e, nfft // 2 + 1))
        w[m, i] = (e - i) / max(e - c, 1)
    return FilterBank(w, edges[1:-1], edges[2:] - edges[:-2], fft_grid(sr, nfft), sr, "htk", "none", (low, high))


def chroma(sr: int, grid: np.ndarray, nchroma: int = 12, tuning: float = 0, ctroct: float = 5.0, octwidth: float | None = 2, base_c: bool = True) -> FilterBank:
    """Gaussian bumps around pitch classes, columns of unit length, weighted by octave; the first row is C."""
    grid = np.asarray(grid, float)
    if len(grid) < 2:
        raise ValueError("the frequency grid needs at least two bins")
    a440 = 440.0 * 2.0 ** (tuning / nchroma)
    place = np.full(len(grid), np.nan)
    place[grid > 0] = nchroma * np.log2(grid[grid > 0] / (a440 / 16))
    if grid[0] <= 0:
        place[0] = place[1] - 1.5 * nchroma
    width = np.append(np.maximum(np.diff(place), 1.0), 1.0)
    half = round(nchroma / 2)
    d = np.mod(place[None, :] - np.arange(nchroma)[:, None] + half + 10 * nchroma, nchroma) - half
    w = np.exp(-0.5 * (2 * d / width) ** 2)
    w /= np.maximum(np.linalg.norm(w, axis=0), 1e-300)
    if octwidth is not None:
        w *= np.exp(-0.5 * ((place / nchroma - ctroct) / octwidth) ** 2)
    if base_c:
        w = np.roll(w, -3 * (nchroma // 12), axis=0)
    return FilterBank(w, np.arange(nchroma, dtype=float), np.ones(nchroma), grid, sr, "chroma")


def cqt_chroma(freq: np.ndarray, bins_per_octave: int, nchroma: int = 12, sr: int = 0) -> FilterBank:
    """Each constant-Q bin counts for the nearest pitch class, from C on."""
    if bins_per_octave % nchroma:
        raise ValueError("bins_per_octave must be a multiple of nchroma")
    n = bins_per_octave // nchroma
    k = round(bins_per_octave * np.log2(freq[0] / (440 * 2.0 ** (-69 / 12)))) + np.arange(len(freq))
    w = np.zeros((nchroma, len(freq)))
    w[((2 * k + n) // (2 * n)) % nchroma, np.arange(len(freq))] = 1
    return FilterBank(w, np.arange(nchroma, dtype=float), np.ones(nchroma), np.asarray(freq, float), sr, "chroma")


def tonnetz_basis(nchroma: int = 12) -> np.ndarray:
    """Six rows: sine and cosine of fifths, minor thirds and major thirds."""
    step = np.arange(nchroma) * (12 / nchroma)
    rows = []
    for turn, r in ((7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5)):
        rows += [r * np.cos(np.pi * (turn * step - 0.5)), r * np.cos(np.pi * turn * step)]
    return np.array(rows)


def dct_matrix(n: int, kind: str = "ortho") -> np.ndarray:
    """DCT-II: ``ortho`` (orthonormal), ``htk`` (every row scaled alike) or ``plain``."""
    m = np.cos(np.pi * np.arange(n)[:, None] * (np.arange(n)[None, :] + 0.5) / n)
    if kind == "plain":
        return m
    m = m * np.sqrt(2 / n)
    if kind == "ortho":
        m[0] /= np.sqrt(2)
    elif kind != "htk":
        raise ValueError("dct must be ortho, htk or plain")
    return m
