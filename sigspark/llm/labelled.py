"""Bounded samples of labelled rows, to fit classifiers on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(1))


def sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], id_col: str = "doc_id", text: str = "text", folds: int = 5) -> pd.DataFrame:
    """``text`` and ``label`` of at most ``bounds[c]`` rows of each class c, never of fold 0.

    The rows of a class with the smallest hashes of their ids are taken, and of rows with one id the text of the smallest
    hash, so the sample does not depend on the order or the partitions of a table. Copies of an id are one row before
    anything is collected, so the driver gets no more rows than the bounds; only labels, not texts, are sorted for it.
    """
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label")).where(F.col("__id").isNotNull() & (fold(F.col("__id"), folds) != 0))
    rows = rows.groupBy("__id").agg(F.max("label").alias("label"))
    parts = [rows.where(F.col("label") == c).orderBy(F.xxhash64("__id"), "__id").limit(n) for c, n in bounds.items()]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.union(p)
    chosen = ids.collect()
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], ids.schema)
    got = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "__id")
    got = got.groupBy("__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return got.select("__id", "text", "label").toPandas().sort_values("__id", ignore_index=True)


def share(labels: DataFrame, label: str, id_col: str = "doc_id", folds: int = 5) -> float | None:
    """The share of rows of class 1 among labelled rows that are not of fold 0; None without any."""
    got = labels.where(fold(F.col(id_col), folds) != 0).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return None if got is None else float(got)


def platt(margin: np.ndarray, y: np.ndarray, share: float = 0.5, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), fitted with smoothed targets by Newton's method with halved steps.

    Classes are weighted so that class 1 has ``share`` of the weight: the share it has where the model will be used.
    """
    n1, n0 = max(1, int(y.sum())), max(1, int((y == 0).sum()))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, share / n1, (1 - share) / n0)

    def loss(v: np.ndarray) -> float:
        z = v[0] * margin + v[1]
        return float((w * (np.logaddexp(0, z) - t * z)).sum() + 1e-5 * ((v[0] - 1) ** 2 + v[1] ** 2))

    v = np.array([1.0, 0.0])
    now = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(v[0] * margin + v[1], -50, 50)))
        r, q = w * (p - t), w * p * (1 - p)
        g = np.array([(r * margin).sum() + 2e-5 * (v[0] - 1), r.sum() + 2e-5 * v[1]])
        h = np.array([[(q * margin * margin).sum() + 2e-5, (q * margin).sum()], [(q * margin).sum(), q.sum() + 2e-5]])
        d, step = np.linalg.solve(h, g), 1.0
        while step > 1e-6 and loss(v - step * d) > now:
            step /= 2
        v = v - step * d
        new = loss(v)
        if now - new < 1e-12:
            break
        now = new
    return float(max(v[0], 1e-3)), float(v[1])
