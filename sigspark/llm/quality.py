"""Quality rules: counts of a text with fixed limits, and a calibrated logistic regression over hashed n-grams."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import labelled
from .common import map_text

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Least words, and most words in a hundred that may be in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8
BITS, SCALE = 18, 30.0
CHAR_ORDERS = (2, 3, 4, 5)
_rng = np.random.default_rng(20240229)
#: Fixed odd multipliers for hashing.
MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def count_base(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines equal to an earlier one, and words in windows of eight found twice or more."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n > REPEAT_WINDOW:
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(w, len(names)) for w in words], np.uint64)
        if len(names) < n:
            m = n - REPEAT_WINDOW + 1
            h = np.zeros(m, np.uint64)
            for j in range(REPEAT_WINDOW):
                h += (ids[j : j + m] + np.uint64(1)) * MIX[j]
            _, inv, count = np.unique(h, return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[inv] > 1)
            if len(at):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + REPEAT_WINDOW, -1)
                repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


@dataclass
class Hashed:
    """Feature numbers of texts laid end to end, the text of each, and 1 / (number of its kind in its text)."""

    ids: np.ndarray
    doc: np.ndarray
    value: np.ndarray


def hashed(texts: list[str | None]) -> Hashed:
    """Character n-grams and word one- and two-grams; a space stands before and after each text."""
    parts = [f" {t} ".encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
    c = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in parts])
    ids, docs, values = [], [], []

    def put(h: np.ndarray, d: np.ndarray, kind: int) -> None:
        h = (h ^ (h >> np.uint64(29))) * MIX[40 + kind]
        ids.append((h >> np.uint64(64 - BITS)).astype(np.int32))
        docs.append(d)
        total = np.bincount(d, minlength=len(texts))
        values.append((1.0 / np.maximum(total, 1))[d].astype(np.float32))

    for n in CHAR_ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            break
        ok = doc[:m] == doc[n - 1 :]
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += c[j : j + m] * MIX[8 + j]
        put(h[ok], doc[:m][ok], n)
    if len(c):
        space = (c == 32) | ((c >= 9) & (c <= 13))
        begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
        if len(begin):
            length = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 - begin
            letters = np.flatnonzero(~space)
            at = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
            h = np.add.reduceat(c[letters] * MIX[16 + (at & 15)], np.cumsum(length) - length)
            d = doc[begin]
            put(h, d, 10)
            pair = d[1:] == d[:-1]
            put((h[:-1] * MIX[6] + h[1:])[pair], d[1:][pair], 11)
    if not ids:
        return Hashed(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return Hashed(np.concatenate(ids), np.concatenate(docs), np.concatenate(values))


@dataclass
class Model:
    """``weights`` of the hashed features; probability of good quality 1 / (1 + exp(-(a * margin + b)))."""

    weights: np.ndarray
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0
    info: dict = field(default_factory=dict)

    def margin(self, texts: list[str | None]) -> np.ndarray:
        h = hashed(texts)
        return self.bias + SCALE * np.bincount(h.doc, weights=self.weights[h.ids] * h.value, minlength=len(texts))

    def probability(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(texts) + self.b, -50, 50)))


def fit(texts: list[str | None], label: list[int], share: float = 0.5, epochs: int = 12, rate: float = 0.3, reg: float = 1e-5, seed: int = 5) -> Model:
    """Adagrad over documents; every fourth is left out and calibrates the probabilities.

    With one class only, or none, every probability is the share of good rows, kept off 0 and 1.
    """
    y = np.array(label, int)
    w = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(w, 0.0, 1.0, float(np.log(share / (1 - share))))
    rows = []
    for t in texts:
        h = hashed([t])
        ids, inv = np.unique(h.ids, return_inverse=True)
        rows.append((ids, (SCALE * np.bincount(inv, weights=h.value, minlength=len(ids))).astype(np.float32)))
    held = np.arange(len(y)) % 4 == 3
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    rng, g2, bias, gb = np.random.default_rng(seed), np.full(1 << BITS, 1e-4, np.float32), 0.0, 1e-4
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            ids, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[ids] @ x + bias, -50, 50)))
            r = float(weight[i] * (p - y[i]))
            g = r * x + reg * w[ids]
            g2[ids] += g * g
            w[ids] -= rate * g / np.sqrt(g2[ids])
            gb += r * r
            bias -= rate * r / gb**0.5
    model = Model(w, float(bias))
    cal = np.flatnonzero(held) if held.any() else np.arange(len(y))
    margin = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in cal])
    model.a, model.b = labelled.platt(margin, y[cal], share)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, most_good: int = 1500, most_bad: int = 1000, id_col: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most so many labelled documents of each class outside of fold 0; that bounds the driver."""
    got = labelled.sample(docs, labels, "quality", {1: most_good, 0: most_bad}, id_col, text)
    share = labelled.share(labels, "quality", id_col)
    return fit(got["text"].tolist(), got["label"].tolist(), 0.5 if share is None else share)


def judge(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds the counts, ``base_failed``, ``quality`` (a probability) and ``kept`` to every row, from the whole text.

    ``kept`` is false where the base rules fail, else whether the probability reaches ``threshold``. Null and empty texts
    have no words and fail. No shuffle; memory holds a block of texts. Columns of ``df`` with these names give way.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def kernel(texts: list[str | None]) -> list:
        base = np.array([count_base(t) for t in texts], np.int64).reshape(-1, 5)
        failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
        p = model.probability(texts)
        return [*(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]

    return map_text(df, text, fields, kernel, keep, block=1 << 18)
