"""What a stage knows about itself on the driver: its grid, its time axis and where it comes from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from .functions.windows import window as make_window


@dataclass(frozen=True)
class SpecMeta:
    """Options and grid of a stage. ``offset`` is where frame 0 begins, in samples; ``freq`` the bins' frequencies."""

    kind: str
    sr: int
    winsize: int = 0
    winstep: int = 0
    window: str = "hanning"
    periodic: bool = True
    offset: int = 0
    nfft: int = 0
    spectrum: str = "power"
    freq: tuple[float, ...] = ()
    parent: SpecMeta | None = None
    options: dict = field(default_factory=dict, compare=False)

    @property
    def nbins(self) -> int:
        return len(self.freq)

    @property
    def overlap(self) -> int:
        return self.winsize - self.winstep

    def grid(self) -> np.ndarray:
        return np.array(self.freq)

    def win(self) -> np.ndarray:
        return make_window(self.window, self.winsize, self.periodic)

    def winnorm(self) -> float:
        """What brings a spectrum to the scale of the signal: one over the window's sum, squared for power."""
        s = self.win().sum()
        return 1 / s**2 if self.spectrum == "power" else 1 / s

    def times(self, frames: int) -> np.ndarray:
        """Centres of frames in seconds."""
        return (self.offset + np.arange(frames) * self.winstep + self.winsize / 2) / self.sr

    def duration(self, frames: int) -> float:
        return (self.offset + (frames - 1) * self.winstep + self.winsize) / self.sr

    def frontend(self) -> SpecMeta:
        """The stage that holds the time-frequency transform."""
        m = self
        while m.parent is not None and m.parent.kind not in ("frames", "signals"):
            m = m.parent
        return m

    def bins(self, low: float, high: float) -> tuple[int, int]:
        """The first and one past the last bin within a range; on a Fourier grid by whole numbers."""
        if self.nfft and self.nbins == self.nfft // 2 + 1:
            lo, hi = -(-int(low) * self.nfft // self.sr), int(high) * self.nfft // self.sr
            return max(lo, 0), min(hi, self.nbins - 1) + 1
        tol = 4 * np.finfo(float).eps * max(abs(high), 1)
        f = self.grid()
        inside = np.flatnonzero((f >= low - tol) & (f <= high + tol))
        return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)

    def child(self, kind: str, freq=None, **options) -> SpecMeta:
        known = {k: options.pop(k) for k in ("spectrum", "nfft", "offset", "winsize", "winstep") if k in options}
        return replace(self, kind=kind, freq=self.freq if freq is None else tuple(float(f) for f in freq), parent=self, options=options, **known)


@dataclass(frozen=True)
class Stage:
    """A DataFrame of frames and what it means; nothing runs until an action."""

    df: object
    meta: SpecMeta
    column: str = "spec"
