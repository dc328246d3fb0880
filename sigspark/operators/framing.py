"""Signals and frames, as native expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import window as make_window
from ..meta import SpecMeta, Stage
from .arrays import grouped

#: Values of frames that leave a signal at a time.
VALUES = 1 << 18


def signals_from(df: DataFrame, key: str, order: str, value: str, sr: int) -> DataFrame:
    """(signal_id, sr, samples) from rows of samples with a total order."""
    rows = df.select(F.col(key).cast("string").alias("signal_id"), F.col(order).alias("n"), F.col(value).cast("double").alias("x"))
    return grouped(rows, "signal_id", "n", "x").select("signal_id", F.lit(sr).alias("sr"), "samples")


def default_winsize(sr: int) -> int:
    return 256 if sr <= 8000 else 512


def movingwindow(winsize: int, winstep: int | None = None) -> dict:
    return {"winsize": winsize, "winstep": winstep or winsize // 2}


def check_frames(winsize: int, winstep: int, preemph: float, win: str, pad_mode: str) -> None:
    if winsize <= 0 or not 0 < winstep <= winsize:
        raise ValueError("need winsize > 0 and 0 < winstep <= winsize")
    if not 0 <= preemph < 1:
        raise ValueError("preemph must be in [0, 1)")
    if pad_mode not in ("constant", "reflect", "edge"):
        raise ValueError("pad_mode must be constant, reflect or edge")
    make_window(win, 4)


def padded(x: np.ndarray, winsize: int, winstep: int, center: bool, pad_mode: str, pad_end: bool) -> np.ndarray:
    """Samples with both ends padded by half a window, or zeros behind for a last partial frame."""
    if center:
        return np.pad(x, winsize // 2, pad_mode)
    if pad_end:
        count = 1 if len(x) <= winsize else 1 + -(-(len(x) - winsize) // winstep)
        return np.r_[x, np.zeros(max(0, (count - 1) * winstep + winsize - len(x)), x.dtype)]
    return x


def frames(signals: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "hanning", periodic: bool = True, center: bool = False, pad_mode: str = "constant", preemph: float = 0.0, dc_removal: bool = False, pad_end: bool = False, key: str = "signal_id", samples: str = "samples") -> Stage:
    """(signal_id, frame, t, energy, x), a row for each frame of each signal; a last partial frame is left out.

    Energy is that of the frame after the mean is taken off and before pre-emphasis. Signals shorter than a frame have
    none. Frames leave their signal in blocks of ``VALUES``, without a shuffle, so a task holds one signal and one block.
    """
    winsize = winsize or default_winsize(sr)
    winstep = winstep or winsize // 2
    check_frames(winsize, winstep, preemph, window, pad_mode)
    offset, least = -(winsize // 2) if center else 0, winsize // 2 if center and pad_mode == "reflect" else 0

    def blocks(signal: np.ndarray, sizes: np.ndarray, x: np.ndarray, gone: np.ndarray | None):
        """Frames of signals that lie one behind the other in ``x``; ``gone`` says which samples are missing."""
        if not len(sizes):
            return
        if center or pad_end:
            cut = np.cumsum(sizes)[:-1]
            fill = lambda c: [padded(v, winsize, winstep, center, pad_mode, pad_end) for v in np.split(c, cut)]
            parts = fill(x)
            sizes = np.array([len(v) for v in parts])
            x, gone = np.concatenate(parts), None if gone is None else np.concatenate(fill(gone))
        count = np.maximum((sizes - winsize) // winstep + 1, 0)
        if not count.sum():
            return
        owner = np.repeat(np.arange(len(sizes)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.cumsum(sizes) - sizes, count) + k * winstep
        view = np.lib.stride_tricks.sliding_window_view
        for i in range(0, len(at), max(1, VALUES // winsize)):
            s = slice(i, i + max(1, VALUES // winsize))
            b, lost = view(x, winsize)[at[s]], None if gone is None else view(gone, winsize)[at[s]]
            if dc_removal:
                b = b - np.cumsum(b, axis=1)[:, -1:] / winsize
                lost = None if lost is None else lost | lost.any(1, keepdims=True)  # what a missing sample is part of is missing
            e = pa.array(np.cumsum(b * b, axis=1)[:, -1], mask=None if lost is None else lost.any(1))
            if preemph:
                b = b - preemph * np.hstack([b[:, :1], b[:, :-1]])
                lost = None if lost is None else lost | np.hstack([lost[:, :1], lost[:, :-1]])
            flat = pa.array(b.ravel(), mask=None if lost is None else lost.ravel())
            yield signal[owner[s]], k[s], (offset + k[s] * float(winstep) + winsize / 2) / sr, e, pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * winsize), flat)

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            sizes = np.where(sizes > least, sizes, 0)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(sizes):  # a long signal, or short ones together
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + VALUES)))
                own = lo + np.flatnonzero(sizes[lo:hi])
                part = lists.take(pa.array(own)) if len(own) < hi - lo else lists.slice(lo, hi - lo)
                v = part.flatten()
                for who, k, t, e, x in blocks(own, sizes[own], np.asarray(v.to_numpy(zero_copy_only=False), float), np.asarray(v.is_null()) if v.null_count else None):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(k.astype(np.int32)), pa.array(t), e, x], names=[key, "frame", "t", "energy", "x"])
                lo = hi

    df = signals.select(key, F.col(samples).cast("array<double>").alias("__x"))
    kind = df.schema[key].dataType.simpleString()
    meta = SpecMeta("frames", sr, winsize, winstep, window, periodic, offset)
    return Stage(df.mapInArrow(run, f"{key} {kind}, frame int, t double, energy double, x array<double>"), meta, "x")


def frame_long(rows: DataFrame, winsize: int, winstep: int, key: str = "signal_id", n: str = "n", last: str = "last_frame") -> DataFrame:
    """(key, frame, j, x) for samples in rows: each goes to the frames that hold it, by arithmetic and not by a range join.

    ``last`` is the number of the signal's last whole frame. A signal of any length is spread over the cluster.
    """
    lo = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col(n) - (winsize - 1)) / winstep).cast("bigint"))
    hi = F.least(F.floor(F.col(n) / winstep).cast("bigint"), F.col(last))
    out = rows.where(F.col(last) >= 0).where(F.col(n) <= F.col(last) * winstep + winsize - 1)
    out = out.select(key, n, "x", F.explode(F.sequence(lo, hi)).alias("frame"))
    return out.select(key, "frame", (F.col(n) - F.col("frame") * winstep).cast("int").alias("j"), "x")


def frames_of_rows(rows: DataFrame, sr: int, winsize: int | None = None, winstep: int | None = None, window: str = "hanning", periodic: bool = True, key: str = "signal_id", n: str = "n", x: str = "x") -> Stage:
    """What ``frames`` gives, from samples in rows numbered from 0: no row ever holds more than a frame, so a signal of any
    length goes through spectra and all frame-local stages spread over the cluster. One aggregate and one shuffle by frame.
    """
    winsize = winsize or default_winsize(sr)
    winstep = winstep or winsize // 2
    check_frames(winsize, winstep, 0.0, window, "constant")
    sizes = rows.groupBy(key).agg((F.max(n) + 1).alias("__size")).select(key, F.floor((F.col("__size") - winsize) / winstep).cast("bigint").alias("last_frame"))
    cells = frame_long(rows.select(key, F.col(n).cast("bigint").alias("n"), F.col(x).cast("double").alias("x")).join(sizes, key), winsize, winstep, key)
    df = cells.groupBy(key, "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda v: v["x"]).alias("x"))
    df = df.select(key, F.col("frame").cast("int").alias("frame"), ((F.col("frame") * F.lit(float(winstep)) + winsize / 2) / sr).alias("t"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("energy"), "x")
    return Stage(df, SpecMeta("frames", sr, winsize, winstep, window, periodic, 0), "x")


def preemphasis_rows(rows: DataFrame, coef: float = 0.97, zi: float | None = None, key: str = "signal_id", n: str = "n", x: str = "x") -> DataFrame:
    """Pre-emphasis of samples in rows, by ``lag``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(n)
    before = F.coalesce(F.lag(x).over(w), F.col(x) if zi is None else F.lit(float(zi)))
    return rows.withColumn("y", F.col(x) - coef * before)


def winframes(stage: Stage) -> DataFrame:
    """Frames times their window."""
    w = F.array(*[F.lit(float(v)) for v in stage.meta.win()])
    return stage.df.withColumn("x", F.zip_with("x", w, lambda a, b: a * b))
