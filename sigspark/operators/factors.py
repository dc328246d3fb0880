"""Non-negative factors of spectrograms of any length: frames stay distributed, only spectra stand on the driver.

A round of multiplicative updates needs, of all frames, the products of ratios and gains: bins x components sums, which each
task adds up for what it holds. So a round is one pass over the frames and one small aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import EPS, _unit
from ..meta import Stage
from ..shared import cut
from .arrays import lists, matrix

#: Numbers that spectra and sums of all signals together may have on the driver.
MOST = 1 << 22
STATE = "signal_id string, frame bigint, v array<double>, h array<double>"
Matrices = dict[str, np.ndarray]


def _by_signal(batch: pa.RecordBatch):
    """(signal, row numbers) of a batch."""
    code = batch.column(0).dictionary_encode()
    at = code.indices.to_numpy()
    for i, name in enumerate(code.dictionary.to_pylist()):
        yield name, np.flatnonzero(at == i)


def _pass(state: DataFrame, kernel, keep: bool) -> DataFrame:
    """Rows of STATE: the frames with new gains, if ``keep``, and for each signal of a batch a row of partial sums, whose
    frame is null. ``kernel(signal, frames, v, h)`` gives (gains, sums)."""

    def run(batches):
        for b in batches:
            frames, v = b.column(1).to_numpy(), matrix(b.column(2))
            h = matrix(b.column(3)) if len(b.column(3).flatten()) else np.zeros((b.num_rows, 1))
            new, sums = None, []
            for name, rows in _by_signal(b):
                gains, total = kernel(name, frames[rows], v[rows], h[rows])
                if new is None:
                    new = np.zeros((b.num_rows, gains.shape[1]))
                new[rows] = gains
                sums.append((name, total))
            if keep and b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists(new)], names=["signal_id", "frame", "v", "h"])
            if sums:
                empty = lists(np.zeros((len(sums), 0)))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sums]), pa.nulls(len(sums), pa.int64()), lists(np.array([x for _, x in sums])), empty], names=["signal_id", "frame", "v", "h"])

    return state.where("frame is not null").mapInArrow(run, STATE)


def _sums(state: DataFrame) -> Matrices:
    """The partial sums of each signal added up."""
    rows = state.where("frame is null").select("signal_id", F.posexplode("v").alias("i", "x")).groupBy("signal_id", "i").agg(F.sum("x").alias("x"))
    got = rows.toArrow()
    out: Matrices = {}
    i, x = got.column("i").to_numpy(), got.column("x").to_numpy()
    for name, at in _by_signal(pa.RecordBatch.from_arrays([got.column("signal_id").combine_chunks()], names=["signal_id"])):
        out[name] = np.empty(len(at))
        out[name][i[at]] = x[at]
    return out


def _first(frames: DataFrame, nb: int, k: int, init: str) -> tuple[Matrices, DataFrame]:
    """Spectra (bins x k) of each signal, and the frames with their gains."""
    counts = {r["signal_id"]: (r["n"], r["s"] / (r["n"] * nb)) for r in frames.groupBy("signal_id").agg(F.count("*").alias("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("s")).collect()}
    for name, (n, _) in counts.items():
        if not 1 <= k <= min(n, nb):
            raise ValueError(f"the {nb} x {n} matrix of {name!r} has no factors of rank {k}")
    if init == "ramps":
        w = {name: np.arange(1, nb * k + 1, dtype=float).reshape(nb, k) for name in counts}
        gains = lambda name, f, v, h: (np.arange(k) * counts[name][0] + f[:, None] + 1.0, np.zeros(1))
        return w, _pass(frames, gains, True)
    if init != "nndsvd":
        raise ValueError("init must be nndsvd or ramps")
    if len(counts) * nb * nb > MOST:
        raise ValueError("too many bins and signals for the driver: factor each signal by wholes.nmf")
    gram = _sums(_pass(frames, lambda name, f, v, h: (np.zeros((len(v), 1)), (v.T @ v).ravel()), False))
    left: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name, g in gram.items():
        s, u = np.linalg.eigh(g.reshape(nb, nb))
        left[name] = np.sqrt(np.maximum(s[::-1][:k], 0)), u[:, ::-1][:, :k]

    def right(name: str, v: np.ndarray) -> np.ndarray:
        s, u = left[name]
        return v @ u / np.where(s > 1e-12 * s[0], s, np.inf)

    sides = lambda t: np.r_[(np.maximum(t, 0) ** 2).sum(0), (np.maximum(-t, 0) ** 2).sum(0)]
    norms = _sums(_pass(frames, lambda name, f, v, h: (np.zeros((len(v), 1)), sides(right(name, v))), False))
    spectra, signs, scales = {}, {}, {}
    for name, (s, u) in left.items():
        b = np.sqrt(norms[name].reshape(2, k))
        a = np.stack([np.linalg.norm(np.maximum(x, 0), axis=0) for x in (u, -u)])
        side = (a * b)[1] > (a * b)[0]
        sign, size = np.where(side, -1, 1), np.maximum(*(a * b))
        na, nb_ = np.where(side, a[1], a[0]), np.where(side, b[1], b[0])
        ok = size > 0
        w = np.where(ok, np.sqrt(s * size) * np.maximum(sign * u, 0) / np.where(ok, na, 1), 0)
        w[:, 0] = np.sqrt(s[0]) * np.abs(u[:, 0])
        w[w < 1e-6] = counts[name][1]
        spectra[name], signs[name], scales[name] = w, sign, np.where(ok, np.sqrt(s * size) / np.where(ok, nb_, 1), 0)

    def gains(name, f, v, h):
        t = right(name, v)
        g = scales[name] * np.maximum(signs[name] * t, 0)
        g[:, 0] = np.sqrt(left[name][0][0]) * np.abs(t[:, 0])
        g[g < 1e-6] = counts[name][1]
        return g, np.zeros(1)

    return spectra, _pass(frames, gains, True)


def update(v: np.ndarray, w: np.ndarray, h: np.ndarray, divergence: str) -> tuple[np.ndarray, np.ndarray]:
    """New gains of frames (rows), and the sums: over, under (bins x k each), the squared move of the gains, the divergence
    before."""
    d = h @ w.T
    over = {"kl": lambda: v / (d + EPS), "is": lambda: v / (d * d + EPS), "euclidean": lambda: v}[divergence]()
    under = {"kl": lambda: np.ones_like(v), "is": lambda: 1 / (d + EPS), "euclidean": lambda: d}[divergence]()
    new = h * (over @ w) / (under @ w + EPS)
    r = (v + EPS) / (d + EPS)
    cost = {"kl": lambda: (v * np.log(r) - v + d).sum(), "is": lambda: (r - np.log(r) - 1).sum(), "euclidean": lambda: ((v - d) ** 2).sum() / 2}[divergence]()
    return new, np.r_[(over.T @ new).ravel(), (under.T @ new).ravel(), ((new - h) ** 2).sum(), cost]


def nmf(s: Stage, k: int, divergence: str = "kl", max_iter: int = 300, thresh: float = 1e-3, norm: str = "max", init: str = "nndsvd", every: int = 10) -> tuple[DataFrame, DataFrame, list[dict[str, float]]]:
    """(signal_id, frame, gains), (signal_id, component, spectrum) and the divergence of each signal before each round.

    What ``wholes.nmf`` computes, for spectrograms whose frames are rows: the same updates, start and end (a signal is done
    when neither factor moves by ``thresh``), so results agree but for rounding. Frames are numbered from 0. Each round's
    frames are persisted and, each ``every`` rounds, checkpointed, so what a lost executor held is made again from there.
    The spectra of all signals are on the driver, within a checked bound: there are few long signals, while each of many
    short ones is better factored in its own row. No frames give empty results.
    """
    if divergence not in ("kl", "is", "euclidean") or norm not in ("max", "l1", "l2"):
        raise ValueError(f"unknown divergence {divergence!r} or norm {norm!r}")
    spark, nb = s.df.sparkSession, s.meta.nbins
    frames = cut(s.df.select("signal_id", F.col("frame").cast("bigint").alias("frame"), F.col("spec").alias("v"), F.array().cast("array<double>").alias("h")))
    signals = frames.select("signal_id").distinct().count()
    if signals * nb * k > MOST:
        raise ValueError("too many signals for the driver: factor each signal by wholes.nmf")
    if frames.where(F.exists("v", lambda x: x < 0)).limit(1).count():
        raise ValueError("found values below 0, which products of non-negative factors cannot give")
    w, state = _first(frames, nb, k, init)
    w = {name: _unit(x, norm) for name, x in w.items()}
    state = cut(state)
    done, history, held = set(), [], None
    for i in range(max_iter):
        now, over = dict(w), frozenset(done)

        def kernel(name, f, v, h, now=now, over=over):
            if name in over:
                return h, np.zeros(2 * nb * k + 2)
            return update(v, now[name], h, divergence)

        new = _pass(state, kernel, True)
        new = cut(new) if i % every == every - 1 else new.persist(StorageLevel.MEMORY_AND_DISK)
        sums = _sums(new)
        if held is not None:
            held.unpersist()
        state, held = new, None if i % every == every - 1 else new
        history.append({name: float(x[-1]) for name, x in sums.items() if name not in done})
        for name, x in sums.items():
            if name in done:
                continue
            up, low = x[: nb * k].reshape(nb, k), x[nb * k : 2 * nb * k].reshape(nb, k)
            moved = _unit(w[name] * up / (low + EPS), norm)
            if max(np.linalg.norm(moved - w[name]), np.sqrt(x[-2])) < thresh:
                done.add(name)
            w[name] = moved
        if len(done) == len(w):
            break
    gains = cut(state.where("frame is not null").select("signal_id", F.col("frame").cast("int").alias("frame"), F.col("h").alias("gains")))
    if held is not None:
        held.unpersist()
    spectra = [(name, c, x[:, c].tolist()) for name, x in sorted(w.items()) for c in range(k)]
    return gains, spark.createDataFrame(spectra, "signal_id string, component int, spectrum array<double>"), history
