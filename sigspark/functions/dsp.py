"""Kernels on one signal: correlation, convolution, analytic signal, resampling, recursions, prediction, synthesis."""

from __future__ import annotations

import math

import numpy as np

from .windows import window

TINY = np.finfo(float).tiny
#: Zero crossings, Kaiser beta and roll-off of the band-limited interpolator.
SINC_QUALITY = {"best": (64, 14.7696565, 0.9475937), "mid": (32, 11.6625806, 0.8987969), "fast": (16, 8.5555046, 0.85)}


def next_pow2(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def half_away(v: float) -> int:
    return int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))


def recursive(x: np.ndarray, b: tuple[float, float], a: float, y0: float = 0.0, x0: float = 0.0) -> np.ndarray:
    """y[n] = b0 x[n] + b1 x[n-1] + a y[n-1] along the first axis; blocks keep powers of ``a`` in range."""
    x = np.asarray(x, float)
    u = b[0] * x
    u[1:] += b[1] * x[:-1]
    if len(x):
        u[0] += b[1] * x0
    y, last = np.empty_like(u), y0
    for i in range(len(u)):
        last = u[i] + a * last
        y[i] = last
    return y


def preemphasis(x: np.ndarray, coef: float = 0.97, zi: float | None = None) -> np.ndarray:
    """x[n] - coef x[n-1]; the sample before the first is ``zi``, or the first itself."""
    x = np.asarray(x, float)
    if not len(x):
        return x.copy()
    return x - coef * np.r_[x[0] if zi is None else zi, x[:-1]]


def deemphasis(y: np.ndarray, coef: float = 0.97, zi: float = 0.0) -> np.ndarray:
    return recursive(y, (1.0, 0.0), coef, zi)


def offset_compensation(x: np.ndarray, coef: float = 0.999) -> np.ndarray:
    """The notch y[n] = x[n] - x[n-1] + coef y[n-1]."""
    return recursive(x, (1.0, -1.0), coef)


def normalize_peak(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(initial=0.0)
    return np.asarray(x, float) / top if top > 0 else np.asarray(x, float)


def hilbert(x: np.ndarray) -> np.ndarray:
    """The analytic signal, along the last axis."""
    n = np.shape(x)[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def czt(x: np.ndarray, m: int | None = None, w: complex | None = None, a: complex = 1.0) -> np.ndarray:
    """Chirp z-transform: sum of x[n] a^-n w^(nk) for k < m, by Bluestein's convolution."""
    x = np.asarray(x, complex)
    n = len(x)
    m = n if m is None else m
    if n < 1 or m < 1:
        raise ValueError("x and m must not be empty")
    log_w = -2j * np.pi / m if w is None else np.log(complex(w))
    k = np.arange(max(m, n))
    chirp = np.exp(log_w * k.astype(float) ** 2 / 2)
    size = next_pow2(n + m - 1)
    left = np.fft.fft(x * np.exp(-np.log(complex(a)) * np.arange(n)) * chirp[:n], size)
    kernel = np.zeros(size, complex)
    kernel[:m] = 1 / chirp[:m]
    kernel[size - n + 1 :] = 1 / chirp[n - 1 : 0 : -1]
    return np.fft.ifft(left * np.fft.fft(kernel))[:m] * chirp[:m]


def czt_band(x: np.ndarray, band: tuple[float, float], m: int | None = None) -> np.ndarray:
    """The transform on m points of a band, in cycles per sample."""
    low, high = band
    if not 0 <= low < high <= 1:
        raise ValueError("band must satisfy 0 <= low < high <= 1")
    m = len(x) if m is None else m
    return czt(x, m, np.exp(-2j * np.pi * (high - low) / m), np.exp(2j * np.pi * low))


def autocorrelate(x: np.ndarray, size: int | None = None) -> np.ndarray:
    """sum of x[n] x[n+k] for each lag k, along the last axis."""
    n = np.shape(x)[-1]
    m = next_pow2(2 * n)
    f = np.fft.rfft(x, m, axis=-1)
    return np.fft.irfft(f.real**2 + f.imag**2, m, axis=-1)[..., : min(n if size is None else size, n)]


def xcorr(x: np.ndarray, y: np.ndarray | None = None, normalize: bool = False) -> np.ndarray:
    """sum of x[n+k] conj(y[n]) for lags from 1 - N to N - 1."""
    y = x if y is None else y
    if len(x) != len(y):
        raise ValueError("x and y must have the same length")
    r = np.correlate(x, y, "full")
    if normalize:
        d = math.sqrt((np.abs(x) ** 2).sum() * (np.abs(y) ** 2).sum())
        r = r / d if d > 0 else r
    return r


def convolve(a: np.ndarray, b: np.ndarray, mode: str = "full") -> np.ndarray:
    """``full``; ``same``: as long as ``a``, from half of ``b`` on; ``valid``: where ``b`` lies within ``a``."""
    full = np.convolve(a, b)
    if mode == "full":
        return full
    if mode == "same":
        return full[len(b) // 2 : len(b) // 2 + len(a)]
    if mode == "valid":
        return full[len(b) - 1 : len(a)]
    raise ValueError("mode must be full, same or valid")


def lpc(x: np.ndarray, order: int) -> np.ndarray:
    """Burg's linear prediction: 1, a1, ... so that x[n] + a1 x[n-1] + ... is least, forwards and backwards."""
    if order < 1 or len(x) <= order:
        raise ValueError("order must be at least 1 and below the length of the signal")
    f = np.asarray(x, float)[1:].copy()
    b = np.asarray(x, float)[:-1].copy()
    a = np.array([1.0])
    for _ in range(order):
        d = f @ f + b @ b
        k = -2 * (f @ b) / d if d > 0 else 0.0
        a = np.r_[a, 0.0] + k * np.r_[a, 0.0][::-1]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def resample_sinc(x: np.ndarray, ratio: float, quality: str = "best", scale: bool = False, bits: int = 9) -> np.ndarray:
    """Band-limited interpolation: every output is a sum over inputs weighted by a windowed sinc, read off a table."""
    if quality not in SINC_QUALITY:
        raise ValueError(f"quality must be one of {sorted(SINC_QUALITY)}")
    if ratio <= 0:
        raise ValueError("the resampling ratio must be positive")
    zeros, beta, roll = SINC_QUALITY[quality]
    x = np.asarray(x, float)
    fine = 1 << bits
    size = zeros * fine + 1
    table = roll * np.sinc(roll * np.linspace(0, zeros, size)) * np.kaiser(2 * size - 1, beta)[size - 1 :]
    table *= min(1.0, ratio)
    slope = np.append(np.diff(table), 0.0)
    pace = min(1.0, ratio)
    step = int(pace * fine)
    out = np.zeros(int(len(x) * ratio))
    reach = size // step + 1
    for lo in range(0, len(out), 65536):
        t = np.arange(lo, min(lo + 65536, len(out))) / ratio
        n = np.floor(t).astype(int)
        acc = np.zeros(len(t))
        for side in (0, 1):
            frac = pace * (t - n) if side == 0 else pace - pace * (t - n)
            off = np.floor(frac * fine).astype(int)
            rest = frac * fine - off
            for j in range(reach):
                at = n - j if side == 0 else n + 1 + j
                k = off + j * step
                ok = (at >= 0) & (at < len(x)) & (j < (size - off) // step)
                k = np.minimum(k, size - 1)
                acc += np.where(ok, (table[k] + rest * slope[k]) * x[np.clip(at, 0, len(x) - 1)], 0.0)
        out[lo : lo + len(t)] = acc
    return out / math.sqrt(ratio) if scale else out


def resample_polyphase(x: np.ndarray, sr: int, new_sr: int, reach: int = 32, beta: float = 8.0) -> np.ndarray:
    """Rational resampling: a Kaiser-windowed sinc at the common rate, taken at the phases that outputs need."""
    if sr == new_sr:
        return np.asarray(x, float)
    g = math.gcd(sr, new_sr)
    up, down = new_sr // g, sr // g
    x = np.asarray(x, float)
    half = reach * max(up, down)
    k = np.arange(-half, half + 1)
    h = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, beta) * (up / max(up, down))
    n_out = -(-len(x) * up // down)
    at = np.arange(n_out) * down
    first = -(-(at - half) // up)
    out = np.zeros(n_out)
    for j in range(2 * half // up + 2):
        i = first + j
        tap = at - i * up + half
        ok = (i >= 0) & (i < len(x)) & (tap >= 0) & (tap <= 2 * half)
        out += np.where(ok, h[np.clip(tap, 0, 2 * half)] * x[np.clip(i, 0, len(x) - 1)], 0.0)
    return out


def resample(x: np.ndarray, sr: int, new_sr: int, method: str = "polyphase", scale: bool = False) -> np.ndarray:
    if new_sr <= 0:
        raise ValueError("sample rates must be positive")
    if method == "polyphase":
        return resample_polyphase(x, sr, new_sr)
    if method == "sinc":
        return np.asarray(x, float) if sr == new_sr else resample_sinc(x, new_sr / sr, scale=scale)
    raise ValueError("method must be polyphase or sinc")


# ---- short-time Fourier on one signal ----


def frame_starts(n: int, winsize: int, winstep: int) -> np.ndarray:
    return np.arange(0, n - winsize + 1, winstep)


def framed(x: np.ndarray, winsize: int, winstep: int) -> np.ndarray:
    """A view: frames x winsize."""
    if len(x) < winsize:
        return np.zeros((0, winsize))
    return np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), winsize)[::winstep]


def istft(coefs: np.ndarray, winsize: int, winstep: int, win: np.ndarray, nfft: int | None = None, method: str = "wola", offset: int = 0, length: int | None = None) -> np.ndarray:
    """Overlap-add of inverse transforms (frames x bins); samples whose summed window is under 1e-6 stay as they are."""
    if method not in ("wola", "ola"):
        raise ValueError("method must be wola or ola")
    nfft = nfft or 2 * (coefs.shape[1] - 1)
    y = np.fft.irfft(coefs, nfft, axis=1)[:, :winsize]
    n = (len(coefs) - 1) * winstep + winsize if len(coefs) else 0
    num, den = np.zeros(n), np.zeros(n)
    for j, row in enumerate(y):
        s = slice(j * winstep, j * winstep + winsize)
        num[s] += row * win if method == "wola" else row
        den[s] += win * win if method == "wola" else win
    out = np.where(den >= 1e-6, num / np.where(den >= 1e-6, den, 1), num)[max(0, -offset) :]
    if length is not None:
        out = np.r_[out[:length], np.zeros(max(0, length - len(out)))]
    return out


def phase_vocoder(coefs: np.ndarray, rate: float, hop: int) -> np.ndarray:
    """Frames (rows) at ``rate`` times the pace: magnitudes between two frames, phases summed from wrapped deviations."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    nf, nb = coefs.shape
    t = np.arange(math.ceil(nf / rate)) * rate
    i = np.floor(t).astype(int)
    frac = (t - i)[:, None]
    more = np.vstack([coefs, np.zeros((2, nb))])
    mag = (1 - frac) * np.abs(more[i]) + frac * np.abs(more[i + 1])
    advance = np.pi * hop * np.arange(nb) / (nb - 1)
    turn = np.angle(more[i + 1]) - np.angle(more[i]) - advance
    turn -= 2 * np.pi * np.sign(turn) * np.floor(np.abs(turn / (2 * np.pi)) + 0.5)
    phase = np.angle(coefs[0]) + np.vstack([np.zeros(nb), np.cumsum(advance + turn, axis=0)[:-1]])
    return mag * np.exp(1j * phase)


def time_stretch(x: np.ndarray, rate: float, winsize: int = 4096, winstep: int | None = None, win: str = "hanning") -> np.ndarray:
    winstep = winstep or winsize // 4
    w = window(win, winsize)
    c = np.fft.rfft(framed(x, winsize, winstep) * w, axis=1)
    return istft(phase_vocoder(c, rate, winstep), winsize, winstep, w, length=half_away(len(x) / rate))


def pitch_shift(x: np.ndarray, n_steps: float, winsize: int = 4096, winstep: int | None = None, win: str = "hanning", quality: str = "fast") -> np.ndarray:
    rate = 2.0 ** (-n_steps / 12)
    z = resample_sinc(time_stretch(x, rate, winsize, winstep, win), rate, quality, scale=True)[: len(x)]
    return np.r_[z, np.zeros(len(x) - len(z))]


# ---- gates ----


def follow(target: np.ndarray, attack: float, release: float) -> np.ndarray:
    """A gain that moves to its target, along the first axis; ``attack`` on the way up, ``release`` on the way down."""
    g = np.zeros(target.shape[1:])
    out = np.empty(target.shape)
    for i, t in enumerate(target):
        a = np.where(t > g, attack, release)
        g = a * g + (1 - a) * t
        out[i] = g
    return out


def noisegate(x: np.ndarray, sr: int, threshold: float = -10, attack: float = 0.05, release: float = 0.2, hold: float = 0.05) -> np.ndarray:
    """Mutes what stays below ``threshold`` dB, ``hold`` seconds after the last loud sample."""
    x = np.asarray(x, float)
    loud = np.abs(x) >= 10 ** (threshold / 20)
    n = np.arange(len(x))
    last = np.maximum.accumulate(np.where(loud, n, -(10**12)))
    is_open = (n - last <= round(hold * sr)).astype(float)
    coef = lambda s: math.exp(-math.log(9) / (sr * s)) if s > 0 else 0.0
    return x * follow(is_open, coef(attack), coef(release))


# ---- synthesis ----


def tone(frequency: float, sr: int, duration: float, phi: float = -math.pi / 2) -> np.ndarray:
    return np.cos(2 * np.pi * frequency * np.arange(round(duration * sr)) / sr + phi)


def chirp(fmin: float, fmax: float, sr: int, duration: float, linear: bool = False, phi: float = -math.pi / 2) -> np.ndarray:
    t = np.arange(round(duration * sr)) / sr
    if linear:
        turns = fmin * t + (fmax - fmin) / (2 * duration) * t**2
    else:
        turns = fmin * duration / math.log(fmax / fmin) * ((fmax / fmin) ** (t / duration) - 1)
    return np.cos(2 * np.pi * turns + phi)


def clicks(times, sr: int, click_freq: float = 1000, click_duration: float = 0.1, length: int | None = None) -> np.ndarray:
    n = round(click_duration * sr)
    k = np.arange(n)
    one = np.sin(2 * np.pi * click_freq * k / sr) * np.exp(-10 * k / n)
    times = list(times)
    size = length if length is not None else (round(max(times) * sr) if times else 0) + n
    out = np.zeros(size)
    for t in times:
        s = round(t * sr)
        m = max(0, min(n, size - s))
        out[s : s + m] += one[:m]
    return out


def synth_f0(times, frequencies, sr: int, amplitudes=None) -> np.ndarray:
    """A sine whose frequency (and amplitude) is held from each time to the next; the phase runs on; 0 Hz is silence."""
    times, frequencies = np.asarray(times, float), np.asarray(frequencies, float)
    if len(times) != len(frequencies) or not len(times):
        raise ValueError("times and frequencies must have the same length, at least 1")
    amp = np.ones(len(times)) if amplitudes is None else np.asarray(amplitudes, float)
    edges = np.rint(times * sr).astype(int)
    n = edges[-1] + (edges[-1] - edges[-2] if len(edges) > 1 else sr)
    which = np.clip(np.searchsorted(edges, np.arange(n), "right") - 1, 0, len(times) - 1)
    f = frequencies[which]
    phase = 2 * np.pi * np.r_[0.0, np.cumsum(f)[:-1]] / sr
    return np.where(f > 0, amp[which] * np.sin(phase), 0.0)


def power_to_db(s: np.ndarray, ref=1.0, amin: float = 1e-10, top_db: float | None = 80, min_db: float | None = None) -> np.ndarray:
    s = np.asarray(s, float)
    r = ref(s) if callable(ref) else ref
    d = 10 * np.log10(np.maximum(s, amin)) - 10 * math.log10(max(r, amin))
    if top_db is not None and d.size:
        d = np.maximum(d, d.max() - top_db)
    return d if min_db is None else np.maximum(d, min_db)


def amplitude_to_db(s: np.ndarray, ref=1.0, amin: float = 1e-5, top_db: float | None = 80, min_db: float | None = None) -> np.ndarray:
    square = (lambda p: ref(np.sqrt(p)) ** 2) if callable(ref) else ref**2
    return power_to_db(np.asarray(s, float) ** 2, square, amin**2, top_db, min_db)


def frame_levels(x: np.ndarray, frame_length: int = 2048, hop_length: int = 512) -> np.ndarray:
    """RMS of centred frames in dB under the loudest."""
    pad = frame_length // 2
    f = framed(np.r_[np.zeros(pad), x, np.zeros(pad)], frame_length, hop_length)
    return power_to_db((f * f).mean(1), ref=np.max, top_db=None)


def split_silence(x: np.ndarray, top_db: float = 60, frame_length: int = 2048, hop_length: int = 512) -> list[tuple[int, int]]:
    """Inclusive 1-based sample intervals of runs of frames above -top_db."""
    loud = np.r_[False, frame_levels(x, frame_length, hop_length) > -top_db, False]
    edge = np.flatnonzero(np.diff(loud.astype(int)))
    return [(int(a) * hop_length + 1, min(len(x), int(b) * hop_length)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def trim_silence(x: np.ndarray, top_db: float = 60, frame_length: int = 2048, hop_length: int = 512) -> tuple[int, int]:
    """(first, last) loud sample, 1-based; (1, 0) where all is silent."""
    runs = split_silence(x, top_db, frame_length, hop_length)
    return (runs[0][0], runs[-1][1]) if runs else (1, 0)
