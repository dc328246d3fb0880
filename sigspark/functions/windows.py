"""Analysis windows. Each symmetric window has a closed form; a periodic one is a symmetric one of n + 1 without its last."""

from __future__ import annotations

import numpy as np


def _ramp(n: int) -> np.ndarray:
    """0 to 1 over n points; one point is the middle."""
    return np.arange(n) / (n - 1) if n > 1 else np.full(n, 0.5)


def _centred(n: int) -> np.ndarray:
    return 2 * _ramp(n) - 1


def rect(n: int) -> np.ndarray:
    return np.ones(n)


def hanning(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * _ramp(n))


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * _ramp(n))


def cosine(n: int) -> np.ndarray:
    return np.sin(np.pi * (np.arange(n) + 0.5) / n)


def lanczos(n: int) -> np.ndarray:
    return np.sinc(_centred(n))


def bartlett(n: int) -> np.ndarray:
    return 1 - np.abs(_centred(n))


def triang(n: int) -> np.ndarray:
    """A triangle that does not reach zero at its ends."""
    k = np.arange(1, n + 1)
    m = (n + 1) / 2
    return 1 - np.abs(k - m) / ((n + 1) / 2 if n % 2 else n / 2)


def bartlett_hann(n: int) -> np.ndarray:
    x = _ramp(n)
    return 0.62 - 0.48 * np.abs(x - 0.5) + 0.38 * np.cos(2 * np.pi * (x - 0.5))


def blackman(n: int) -> np.ndarray:
    x = _ramp(n)
    return 0.42 - 0.5 * np.cos(2 * np.pi * x) + 0.08 * np.cos(4 * np.pi * x)


def povey(n: int) -> np.ndarray:
    return hanning(n) ** 0.85


def bohman(n: int) -> np.ndarray:
    v = np.abs(_centred(n))
    return (1 - v) * np.cos(np.pi * v) + np.sin(np.pi * v) / np.pi


def kaiser(n: int, beta: float = 5.0) -> np.ndarray:
    return np.kaiser(n, beta)


def gauss(n: int, alpha: float = 2.5) -> np.ndarray:
    return np.exp(-0.5 * (alpha * _centred(n)) ** 2)


def point(n: int) -> np.ndarray:
    w = np.zeros(n)
    w[(n + 1) // 2 - 1] = 1
    return w


WINDOWS = {
    "rect": rect, "hanning": hanning, "hamming": hamming, "cosine": cosine, "lanczos": lanczos, "triang": triang, "bartlett": bartlett,
    "bartlett_hann": bartlett_hann, "blackman": blackman, "povey": povey, "bohman": bohman, "kaiser": kaiser, "gauss": gauss, "point": point,
    "triangular": bartlett, "etsi": triang,
}


def window(name: str, n: int, periodic: bool = True) -> np.ndarray:
    """The window ``name`` of n samples."""
    if name not in WINDOWS:
        raise ValueError(f"window must be one of {sorted(WINDOWS)}, got {name!r}")
    if n < 1:
        raise ValueError("a window has at least one sample")
    return WINDOWS[name](n + 1)[:-1] if periodic else WINDOWS[name](n)
