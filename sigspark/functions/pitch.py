"""Pitch and harmonicity of frames: each function takes frames x samples and gives a value for each frame."""

from __future__ import annotations

import math

import numpy as np

from .dsp import TINY, autocorrelate, next_pow2
from .windows import window


def lag_range(sr: int, bounds, n: int) -> tuple[int, int]:
    low, high = max(1, math.floor(sr / bounds[1])), min(n - 1, math.ceil(sr / bounds[0]))
    if low >= high:
        raise ValueError(f"pitch range {bounds} is not resolvable with {n}-sample frames at {sr} Hz")
    return low, high


def refined(v: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The vertex of the parabola through each row's value at k and its neighbours; k itself at the ends."""
    rows = np.arange(len(v))
    inner = (k > 0) & (k < v.shape[1] - 1)
    i = np.clip(k, 1, v.shape[1] - 2)
    a, b, c = v[rows, i - 1], v[rows, i], v[rows, i + 1]
    d = a - 2 * b + c
    return np.where(inner & (d != 0), k + (a - c) / (2 * np.where(d == 0, 1, d)), k.astype(float))


def normalised_autocorrelation(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Autocorrelation up to lag size - 1, and the same by the energies of the frame and of its part beyond the lag."""
    r = autocorrelate(x, size)
    energy = (x * x).sum(1, keepdims=True)
    tail = energy - np.c_[np.zeros(len(x)), np.cumsum(x * x, axis=1)[:, : size - 1]]
    return r, r / (np.sqrt(np.maximum(r[:, :1], TINY)) * np.sqrt(np.maximum(tail, TINY)))


def ncf(x: np.ndarray, sr: int, bounds=(50, 400), threshold: float = 0) -> np.ndarray:
    low, high = lag_range(sr, bounds, x.shape[1])
    r, q = normalised_autocorrelation(x, high + 1)
    k = low + q[:, low:].argmax(1)
    best = q[np.arange(len(x)), k]
    ok = (r[:, 0] > 0) & (best >= threshold)
    return np.where(ok, sr / np.where(ok, refined(r, k), 1), 0.0)


def yin(x: np.ndarray, sr: int, bounds=(50, 400), threshold: float = 0.1) -> np.ndarray:
    """The first dip of the mean-normalised difference function under the threshold, else its least value."""
    n = x.shape[1]
    low, high = lag_range(sr, bounds, n // 2 + 1)
    w = n - high
    d = np.stack([((x[:, :w] - x[:, k : k + w]) ** 2).sum(1) for k in range(high + 1)], axis=1)
    run = np.cumsum(d[:, 1:], axis=1)
    c = np.ones_like(d)
    c[:, 1:] = np.where(run > 0, d[:, 1:] * np.arange(1, high + 1) / np.where(run > 0, run, 1), 1.0)
    seg = c[:, low:]
    under = seg < threshold
    first = np.where(under.any(1), under.argmax(1), -1)
    falls = np.c_[seg[:, 1:] < seg[:, :-1], np.zeros(len(x), bool)]
    # from the first value under the threshold down to where the function stops falling
    stops = np.where(np.arange(seg.shape[1]) >= first[:, None], ~falls, False).argmax(1)
    k = low + np.where(first >= 0, stops, seg.argmin(1))
    lag = refined(c, k)
    return np.where(lag > 0, sr / np.where(lag > 0, lag, 1), 0.0)


def cep(x: np.ndarray, sr: int, bounds=(50, 400), threshold: float = 0) -> np.ndarray:
    """The peak of the real cepstrum."""
    m = next_pow2(2 * x.shape[1])
    c = np.fft.irfft(np.log(np.abs(np.fft.rfft(x, m, axis=1)) + np.finfo(float).eps), m, axis=1)
    low, high = lag_range(sr, bounds, m // 2)
    k = low + c[:, low : high + 1].argmax(1)
    ok = c[np.arange(len(x)), k] > threshold
    return np.where(ok, sr / refined(c, k), 0.0)


def _spectrum(x: np.ndarray, win: str, nfft: int) -> np.ndarray:
    return np.abs(np.fft.fft(x * window(win, x.shape[1]), nfft, axis=1))


def _harmonic_bins(sr: int, bounds, harmonics: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    floor = 1 << (max(1, sr).bit_length() - 1)
    near = floor if sr - floor < 2 * floor - sr or floor == sr else 2 * floor
    nfft = max(near, next_pow2(n))
    h = min(max(harmonics, 1), max(1, sr // (bounds[1] + 1)))
    j = np.arange(math.ceil(bounds[0] * nfft / sr), math.floor(bounds[1] * nfft / sr) + 1)
    return j, (j[:, None] * np.arange(1, h + 1)) % nfft, nfft


def hps(x: np.ndarray, sr: int, bounds=(50, 400), threshold: float = 0, harmonics: int = 5, win: str = "hamming") -> np.ndarray:
    """The bin with the largest product over its harmonics."""
    j, at, nfft = _harmonic_bins(sr, bounds, harmonics, x.shape[1])
    return j[_spectrum(x, win, nfft)[:, at].prod(2).argmax(1)] * sr / nfft


def lhs(x: np.ndarray, sr: int, bounds=(50, 400), threshold: float = 0, harmonics: int = 5, win: str = "hamming") -> np.ndarray:
    """The bin with the largest sum of logarithms over its harmonics."""
    j, at, nfft = _harmonic_bins(sr, bounds, harmonics, x.shape[1])
    return j[np.log(np.maximum(_spectrum(x, win, nfft), TINY))[:, at].sum(2).argmax(1)] * sr / nfft


def pef(x: np.ndarray, sr: int, bounds=(50, 400), threshold: float = 0, cutoff: float = 4000, alpha: float = 10, beta: float = 0.5, gamma: float = 1.8, win: str = "hamming") -> np.ndarray:
    """The power spectrum on a logarithmic axis, correlated with a comb whose mean is zero."""
    n = x.shape[1]
    p = np.abs(np.fft.rfft(x * window(win, n), 2 * n, axis=1)) ** 2
    grid = np.logspace(1, math.log10(min(max(cutoff, bounds[1]), sr / 2 - 1)), 2 * n)
    u = grid / (sr / 2 / n)
    k = np.minimum(u.astype(int), n - 1)
    width = np.empty(2 * n)
    width[1:-1] = (grid[2:] - grid[:-2]) / (4 * n)
    width[0], width[-1] = width[1], width[-2]
    line = ((1 - (u - k)) * p[:, k] + (u - k) * p[:, k + 1]) * width
    q = np.logspace(math.log10(beta), math.log10(alpha + beta), n)
    comb = 1 / (gamma - np.cos(2 * np.pi * q))
    d = np.diff(np.r_[q[0], (q[:-1] + q[1:]) / 2, q[-1]])
    comb = comb - (d * comb).sum() / d.sum()
    pad = int((q < 1).sum())
    low, high = (int(np.abs(grid - f).argmin()) for f in bounds)
    ext = np.pad(line, ((0, 0), (pad, n)))
    score = np.stack([ext[:, lag : lag + n] @ comb for lag in range(low, high + 1)], axis=1)
    return grid[low + score.argmax(1)]


def stft_sieve(x: np.ndarray, sr: int, bounds=(50, 400), threshold: float = 20, win: str = "hamming", tolerance: float = 0.03) -> np.ndarray:
    """Spectral peaks within ``threshold`` dB of the top; the candidate (a peak, its half or third) that explains most."""
    nfft = next_pow2(x.shape[1])
    level = 20 * np.log10(np.maximum(_spectrum(x, win, nfft)[:, : nfft // 2 + 1], TINY))
    last = min(nfft // 2, math.ceil(10 * bounds[1] * nfft / sr))
    out = np.zeros(len(x))
    for i, v in enumerate(level):
        floor = v.max() - threshold
        k = np.arange(1, last)
        k = k[(v[k] > v[k - 1]) & (v[k] >= v[k + 1]) & (v[k] > floor)]
        if not len(k):
            continue
        a, b, c = v[k - 1], v[k], v[k + 1]
        den = a - 2 * b + c
        shift = np.where(den == 0, 0, (a - c) / (2 * np.where(den == 0, 1, den)))
        f, weight = (k + shift) * sr / nfft, b - (a - c) * shift / 4 - floor
        cand = (f[:, None] / np.arange(1, 4)).ravel()
        cand = cand[(cand >= bounds[0]) & (cand <= bounds[1])]
        if len(cand):
            h = np.rint(f[None, :] / cand[:, None])
            near = (h >= 1) & (np.abs(f[None, :] - h * cand[:, None]) <= tolerance * h * cand[:, None])
            out[i] = cand[(near * weight).sum(1).argmax()]
    return out


METHODS = {"ncf": (ncf, 0.0), "yin": (yin, 0.1), "cep": (cep, 0.0), "hps": (hps, 0.0), "lhs": (lhs, 0.0), "pef": (pef, 0.0), "stft": (stft_sieve, 20.0)}


def harmonic_ratio(x: np.ndarray, sr: int, bounds=(50, 400)) -> np.ndarray:
    """The largest normalised autocorrelation within the lags of the pitch range, at least 0."""
    low, high = lag_range(sr, bounds, x.shape[1])
    r, q = normalised_autocorrelation(x, high + 1)
    return np.where(r[:, 0] > 0, np.maximum(q[:, low:].max(1), 0), 0.0)


def harmonic_count(power: np.ndarray, sr: int, nfft: int, bounds=(27, 4000), count_range=None, rise: float = 15.0, within: float = 48.0, apart: float = 30.0) -> np.ndarray:
    """The number of spectral peaks in a range that stand ``rise`` dB above both sides and ``within`` dB of the highest;
    of peaks nearer than ``apart`` Hz the higher counts. Those within ``count_range`` are counted, else all in the range."""
    counted = count_range or bounds
    level = 10 * np.log10(np.maximum(power, TINY) / nfft / nfft)
    low, high = math.floor(bounds[0] * nfft / sr), min(math.ceil(bounds[1] * nfft / sr), nfft // 2 - 1)
    out = np.zeros(len(level), int)
    for i, v in enumerate(level):
        k = np.arange(max(1, low), high)
        k = k[(v[k] > v[k - 1]) & (v[k] > v[k + 1]) & (v[k] >= v[low : high + 1].max() - within)]
        chosen: list[int] = []
        for p in k[np.argsort(-v[k], kind="stable")]:
            if any(abs(p - c) * sr / nfft < apart for c in chosen):
                continue
            left, right = p, p
            while left > 0 and v[left - 1] <= v[p] and v[p] - v[left] < rise:
                left -= 1
            while right < len(v) - 1 and v[right + 1] <= v[p] and v[p] - v[right] < rise:
                right += 1
            if v[p] - v[left] >= rise and v[p] - v[right] >= rise:
                chosen.append(int(p))
        out[i] = sum(counted[0] < c * sr / nfft < counted[1] for c in chosen)
    return out
