"""Frames of signals whose samples arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import window as make_window

OUT = "signal_id string, frame long, energy double, x array<double>"
STATE = "next_frame long, first_n long, tail array<double>"


def stream_frames(samples: DataFrame, winsize: int, winstep: int) -> DataFrame:
    """Frames of a stream of (signal_id, n, x): count-based sliding windows, each emitted once its last sample is there.

    The state of a signal is what the next frame may need: less than a window of samples, whatever its length. Samples of a
    signal must come in order of n between batches; within a batch they are sorted. Repeated and late samples are left out.
    """
    if not 0 < winstep <= winsize:
        raise ValueError("need 0 < winstep <= winsize")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame, first, tail = state.get if state.exists else (0, 0, [])
        got = pd.concat(list(batches)).sort_values("n").drop_duplicates("n")
        have = first + len(tail)
        got = got[got["n"] >= have]
        x = np.r_[np.asarray(tail, float), got["x"].to_numpy(float)]
        rows = []
        while frame * winstep - first + winsize <= len(x):
            at = frame * winstep - first
            w = x[at : at + winsize]
            rows.append((key[0], frame, float(w @ w), w.tolist()))
            frame += 1
        keep = max(0, min(frame * winstep - first, len(x)))
        state.update((frame, first + keep, x[keep:].tolist()))
        yield pd.DataFrame(rows, columns=["signal_id", "frame", "energy", "x"])

    return samples.groupBy("signal_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


# ---- frames that may come late: a stream of (signal_id, frame, ts, values) ----

WAITING = "next_frame long, last_ms long, frames array<long>, values array<double>, kept array<double>"


def _in_order(frames: DataFrame, columns: list[str], late: str, out: str, begin: Callable, take: Callable, finish: Callable) -> DataFrame:
    """``take(kept, frame, values)`` on each signal's frames in order, whatever the order in which they come.

    Frames that come before one that is missing wait in the state. What the watermark has passed does not come any more:
    when it passes the last time seen of a signal, missing frames are given up, ``finish`` emits what is left, and the state
    is dropped. Repeated frames count once, and frames behind what has been taken are left out. ``take`` and ``finish`` give
    (kept, rows); kept is a vector, rows are tuples behind the signal's id.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, last, waiting, flat, kept = state.get if state.exists else (0, 0, [], [], None)
        width = len(flat) // len(waiting) if waiting else 0
        held = {f: np.asarray(flat[i * width : (i + 1) * width], float) for i, f in enumerate(waiting)}
        kept, rows = begin() if kept is None else np.asarray(kept, float), []
        ended = state.hasTimedOut
        if not ended:
            for b in batches:
                for f, ms, *v in zip(b["frame"], b["ts"].astype("datetime64[ms]").astype("int64"), *(b[c] for c in columns), strict=True):
                    last = max(last, int(ms))
                    if f >= number:
                        held.setdefault(int(f), np.concatenate([np.asarray(x, float) for x in v]))
        while held and (ended or number in held):
            number = min(held)
            kept, made = take(kept, number, held.pop(number))
            rows += made
            number += 1
        if ended:
            rows += finish(kept, number)
            state.remove()
        else:
            state.update((number, last, sorted(held), np.concatenate([held[f] for f in sorted(held)]).tolist() if held else [], kept.tolist()))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["signal_id", *names])

    return frames.withWatermark("ts", late).groupBy("signal_id").applyInPandasWithState(step, f"signal_id string, {out}", WAITING, "append", "EventTimeTimeout")


def stream_istft(frames: DataFrame, winsize: int, winstep: int, window: str = "hanning", nfft: int | None = None, method: str = "wola", late: str = "1 minute") -> DataFrame:
    """(signal_id, n, x) of a stream of (signal_id, frame, ts, re, im): each sample once no later frame can reach it.

    The state of a signal is the sum of frames that overlap what comes next: less than a window of samples, and the frames
    that wait for a missing one. A frame that never comes is silence. Together the samples are what ``spectral.istft`` gives.
    """
    if method not in ("wola", "ola") or not 0 < winstep <= winsize:
        raise ValueError("method must be wola or ola, and 0 < winstep <= winsize")
    w, nfft = make_window(window, winsize), nfft or winsize
    weight = w * w if method == "wola" else w

    def rows(num: np.ndarray, den: np.ndarray, first: int) -> list[tuple]:
        x = np.where(den >= 1e-6, num / np.where(den >= 1e-6, den, 1), num)
        return list(zip(range(first, first + len(x)), x.tolist(), strict=True))

    def begin() -> np.ndarray:  # the number of the first sample, then sums and weights
        return np.zeros(1 + 2 * winsize)

    def take(kept: np.ndarray, frame: int, values: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        first, num, den = int(kept[0]), kept[1 : 1 + winsize].copy(), kept[1 + winsize :].copy()
        at, out = frame * winstep, []
        gone = min(at - first, winsize)
        if gone > 0:
            out = [r for r in rows(num[:gone], den[:gone], first) if frame > 0]
            num, den = np.r_[num[gone:], np.zeros(gone)], np.r_[den[gone:], np.zeros(gone)]
            out += [(n, 0.0) for n in range(first + gone, at)]  # missing frames
        half = len(values) // 2
        y = np.fft.irfft(values[:half] + 1j * values[half:], nfft)[:winsize]
        num += y * w if method == "wola" else y
        den += weight
        return np.r_[at, num, den], out

    def finish(kept: np.ndarray, frame: int) -> list[tuple]:
        return rows(kept[1 : 1 + winsize], kept[1 + winsize :], int(kept[0])) if frame else []

    return _in_order(frames, ["re", "im"], late, "n long, x double", begin, take, finish)


def stream_onset(spectra: DataFrame, floor: float = 1e-10, late: str = "1 minute") -> DataFrame:
    """(signal_id, frame, value) of a stream of (signal_id, frame, ts, spec) of powers: the mean rise in dB over the frame
    before, 0 for the first; powers are held at ``floor``, since the top of a stream is not known. The state is a spectrum."""

    def take(kept: np.ndarray, frame: int, power: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        db = 10 * np.log10(np.maximum(power, floor))
        rise = float(np.maximum(db - kept, 0).mean()) if len(kept) else 0.0
        return db, [(frame, rise)]

    return _in_order(spectra, ["spec"], late, "frame long, value double", lambda: np.zeros(0), take, lambda kept, frame: [])


def windowed_levels(samples: DataFrame, time: str = "ts", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Level statistics of each signal over tumbling windows of event time, with a watermark for late samples."""
    rows = samples.withWatermark(time, late).groupBy(F.window(time, every), "signal_id")
    return rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
