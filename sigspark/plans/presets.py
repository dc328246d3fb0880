"""Cepstral coefficients as known toolkits define them, and the standard set with deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp, filterbanks
from ..meta import Stage
from ..operators import spectral, wholes

EPS32, EPS64 = 1.1920928955078125e-07, 2.220446049250313e-16


def ms(sr: int, milliseconds: float) -> int:
    """Samples, halves to even."""
    return round(sr * milliseconds / 1000)


def _chain(signals: DataFrame, sr: int, bank, frame: dict, spectrum: str, nfft: int, scale: float = 1.0, **cepstrum) -> Stage:
    s = spectral.spectrogram(signals, sr, **frame, nfft=nfft, spectrum=spectrum, scale=scale)
    return spectral.mfcc(spectral.band_spec(s, bank(s.meta)), **cepstrum)


def mfcc_matlab(signals: DataFrame, sr: int, nbands: int = 32, ncoeffs: int = 13) -> Stage:
    win = ms(sr, 30)
    bank = lambda m: filterbanks.auditory(sr, grid=m.grid(), nbands=nbands)
    return _chain(signals, sr, bank, {"winsize": win, "winstep": win - ms(sr, 20), "window": "hamming"}, "power", win, ncoeffs=ncoeffs)


def mfcc_htk(signals: DataFrame, sr: int, nbands: int = 20, ncoeffs: int = 12) -> Stage:
    win = ms(sr, 25)
    bank = lambda m: filterbanks.auditory(sr, grid=m.grid(), nbands=nbands, norm="none", domain="warped")
    frame = {"winsize": win, "winstep": ms(sr, 10), "window": "hamming", "periodic": False, "preemph": 0.97}
    return _chain(signals, sr, bank, frame, "magnitude", dsp.next_pow2(win), 32768.0, ncoeffs=ncoeffs, rect="nlog", floor=1.0, dct="htk", first=1, lifter=22)


def mfcc_kaldi(signals: DataFrame, sr: int, nbands: int = 23, ncoeffs: int = 13) -> Stage:
    win = ms(sr, 25)
    bank = lambda m: filterbanks.auditory(sr, grid=m.grid(), nbands=nbands, norm="none", domain="warped", freqrange=(20, sr // 2))
    frame = {"winsize": win, "winstep": ms(sr, 10), "window": "povey", "periodic": False, "preemph": 0.97, "dc_removal": True}
    return _chain(signals, sr, bank, frame, "power", dsp.next_pow2(win), ncoeffs=ncoeffs, rect="nlog", floor=EPS32, lifter=22, energy="raw")


def mfcc_librosa(signals: DataFrame, sr: int, nfft: int = 2048, nbands: int = 128, ncoeffs: int = 20, top_db: float = 80) -> Stage:
    bank = lambda m: filterbanks.auditory(sr, grid=m.grid(), nbands=nbands, scale="slaney")
    return _chain(signals, sr, bank, {"winsize": nfft, "winstep": nfft // 4, "center": True}, "power", nfft, ncoeffs=ncoeffs, rect="db", floor=1e-10, top_db=top_db, lifter_offset=1)


def mfcc_etsi(signals: DataFrame, sr: int, nbands: int = 23, ncoeffs: int = 13) -> Stage:
    win = ms(sr, 25)
    nfft = dsp.next_pow2(win)
    clean = wholes.map_signal(signals, lambda x: dsp.offset_compensation(x) * 32768.0)
    bank = lambda m: filterbanks.etsi(sr, nfft, nbands)
    frame = {"winsize": win, "winstep": ms(sr, 10), "window": "hamming", "periodic": False, "preemph": 0.97}
    return _chain(clean, sr, bank, frame, "magnitude", nfft, ncoeffs=ncoeffs, rect="nlog", floor=2e-22, dct="plain", energy="raw", energy_mode="append", energy_floor=1.9287498479639178e-22)


def mfcc_psf(signals: DataFrame, sr: int, nfft: int = 512, nbands: int = 26, ncoeffs: int = 13) -> Stage:
    win = ms(sr, 25)
    sharp = signals.withColumn("samples", F.transform("samples", lambda v, i: v - F.when(i == 0, 0.0).otherwise(0.97 * F.element_at("samples", F.greatest(i, F.lit(1))))))
    s = spectral.spectrogram(sharp, sr, winsize=win, winstep=ms(sr, 10), window="rect", pad_end=True, nfft=nfft, scale=1.0 / nfft)
    s2 = Stage(s.df.withColumn("energy", F.aggregate("spec", F.lit(0.0), lambda a, v: a + v)), s.meta)
    return spectral.mfcc(spectral.band_spec(s2, filterbanks.psf(sr, nfft, nbands)), ncoeffs=ncoeffs, rect="nlog", floor=EPS64, lifter=22, energy="raw", energy_floor=EPS64)


def xxcc_standard(s: Stage, ncoeffs: int = 13, delta_length: int = 9, rect: str = "mlog", energy: str | None = "raw", energy_mode: str = "replace") -> tuple[Stage, Stage, Stage]:
    """Coefficients, and two transposed deltas of them."""
    c = spectral.mfcc(s, ncoeffs, rect=rect, dither=True, energy=energy, energy_mode=energy_mode)
    d = spectral.delta(c, delta_length, "transposed")
    return c, d, spectral.delta(d, delta_length, "transposed")
