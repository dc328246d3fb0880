"""Frequency scales: conversions, band edges, and the warped coordinate of each."""

from __future__ import annotations

import numpy as np

LINEAR_STEP = 200 / 3
LOG_STEP = np.log(6.4) / 27
ERB = 21.3654
ERB_SLOPE = 0.004368


def hz_to_htk(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def htk_to_hz(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


def hz_to_slaney(f):
    f = np.asarray(f, float)
    return np.where(f < 1000, f / LINEAR_STEP, 1000 / LINEAR_STEP + np.log(np.maximum(f, 1e-300) / 1000) / LOG_STEP)


def slaney_to_hz(m):
    m = np.asarray(m, float)
    knee = 1000 / LINEAR_STEP
    return np.where(m < knee, m * LINEAR_STEP, 1000 * np.exp(LOG_STEP * (m - knee)))


def hz_to_bark(f, corrected: bool = True):
    f = np.asarray(f, float)
    z = 26.81 * f / (1960 + f) - 0.53
    if corrected:
        z = np.where(z < 2, z + 0.15 * (2 - z), np.where(z > 20.1, z + 0.22 * (z - 20.1), z))
    return z


def bark_to_hz(z):
    z = np.asarray(z, float)
    z = np.where(z < 2, (z - 0.3) / 0.85, np.where(z > 20.1, (z + 4.422) / 1.22, z))
    return 1960 * (z + 0.53) / (26.28 - z)


def hz_to_erb(f):
    return ERB * np.log10(1 + np.asarray(f, float) * ERB_SLOPE)


def erb_to_hz(e):
    return (10 ** (np.asarray(e, float) / ERB) - 1) / ERB_SLOPE


SCALES = ("htk", "slaney", "bark", "linspace", "erb", "octave", "logspace")


def band_edges(scale: str, low: float, high: float, nbands: int, bins_per_octave: int = 12) -> np.ndarray:
    """nbands + 2 edges in Hz; the inner ones are the band centres.

    On htk, slaney, bark and erb the range holds the outer edges; on linspace and logspace the first and last centre; octave
    goes up from a step below ``low`` and takes no notice of ``high``.
    """
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {SCALES}, got {scale!r}")
    to_from = {"htk": (hz_to_htk, htk_to_hz), "slaney": (hz_to_slaney, slaney_to_hz), "bark": (hz_to_bark, bark_to_hz), "erb": (hz_to_erb, erb_to_hz)}
    if scale in to_from:
        to, back = to_from[scale]
        return back(np.linspace(to(low), to(high), nbands + 2))
    if scale in ("linspace", "logspace") and nbands < 2:
        raise ValueError(f"{scale} needs at least 2 bands")
    if scale == "linspace":
        step = (high - low) / (nbands - 1)
        return np.linspace(low - step, high + step, nbands + 2)
    if low <= 0:
        raise ValueError(f"the {scale} scale needs a positive low frequency")
    if scale == "octave":
        if not 4 <= bins_per_octave <= 48:
            raise ValueError("bins_per_octave must be from 4 to 48")
        first = round(bins_per_octave * np.log2(low / 440)) - 1
        return 440 * 2.0 ** ((first + np.arange(nbands + 2)) / bins_per_octave)
    a, b = np.log2(low / 440), np.log2(high / 440)
    step = (b - a) / (nbands - 1)
    return 440 * 2.0 ** np.linspace(a - step, b + step, nbands + 2)


def warp(scale: str, f, bins_per_octave: int = 12):
    """The coordinate in which a scale is even."""
    f = np.asarray(f, float)
    with np.errstate(divide="ignore"):
        return {
            "htk": hz_to_htk, "slaney": hz_to_slaney, "bark": lambda x: hz_to_bark(x, corrected=False), "linspace": lambda x: x, "erb": hz_to_erb,
            "octave": lambda x: bins_per_octave * np.log2(x / 440), "logspace": lambda x: np.log2(x / 440),
        }[scale](f)
