"""Toxicity: a subsequence string-kernel SVM over Nystroem landmarks, trained on labelled documents.

An instance is a window of ``LEAST`` to ``WINDOW`` letters within a word, or a shorter word. The kernel of two windows is the
sum over all subsequences of ``ORDER`` letters that both hold, each occurrence weighted by ``DECAY`` to the power of the span
it covers, so a letter put in or left out weakens a match and does not end it. A document scores as its worst window.
Documents carry the labels, so training goes around: fit, find the worst window of each toxic document and the worst of each
clean one, fit again; windows of what marks toxic documents stay in throughout, so that each insult is learnt, not only the
worst of a document.
A linear SVM on landmark features is linear in the subsequences too; for scoring it is folded in one table over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled
from .common import map_text, release

ORDER, WINDOW, DECAY = 4, 7, 0.85
CLASSES = 36
#: What stands for the ends of a short word.
EDGE = 35
#: Words of up to so many letters have no subsequence; words of so many letters and fewer are parts of words. See ``units``.
SHORT, PARTS = 3, 2
SEPARATOR = 255
# Digits and signs written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}


def _classes() -> np.ndarray:
    """The letter class of each byte: 1-26 a-z in both cases, 27-34 the last byte of other letters, 0 for what is left out."""
    t = np.zeros(256, np.uint8)
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = i + 1
    for a, b in LOOKALIKES.items():
        t[ord(a)] = t[ord(b)]
    for b in range(0x80, 0xC0):
        t[b] = 27 + (b & 7)
    for b in b" \t\n\x0b\x0c\r":
        t[b] = SEPARATOR
    return t


TABLE = _classes()
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


PLACES = np.array(list(combinations(range(WINDOW), ORDER)))
SPANS = PLACES[:, -1] - PLACES[:, 0] + 1
#: A gram that no clean document holds is learnt from so many toxic documents on; from the lower number on where these hold
#: no other gram that is learnt, and a window that no gram explains from so many on.
SURE, FEW, FEWEST = 6, 3, 2
#: Positions that are scored at a time.
CHUNK = 150_000
#: The letters of a window, where the word has as many.
LEAST = 6
#: The weight of the first windows beside that of the worst ones.
SEEDS = 0.3
#: By the number of letters of a window, the norm of its subsequences if they all differ.
NORMS = np.sqrt([max(DECAY**ORDER, sum(DECAY ** (2 * s) for s, e in zip(SPANS, PLACES[:, -1], strict=True) if e < n)) if n >= ORDER else 1.0 for n in range(WINDOW + 1)]).astype(np.float32)


@dataclass
class Units:
    """Words as letter classes: ``codes`` of all, where each starts, its length and its document."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray


def units(texts: list[str | None]) -> Units:
    """What is scored: words, which white space parts, without signs; a letter stretched to three and more counts once.

    Words of one letter in a row, or of two, are taken together, so that one cut in such parts is seen. Words of two letters to
    ``SHORT`` are also taken between edges, so that short insults have subsequences.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    c = TABLE[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    doc = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
    kept = c != 0
    c, doc = c[kept], doc[kept]
    new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]] if len(c) else c)
    run = np.diff(np.r_[new, len(c)])
    kept = np.ones(len(c), bool)  # a letter three times and more in a row counts once
    kept[np.repeat(run > 2, run)] = False
    kept[new] = True
    c, doc = c[kept], doc[kept]
    sep = c == SEPARATOR
    number = np.cumsum(sep)[~sep]
    letters, d = c[~sep], doc[~sep]
    if not len(letters):
        z = np.zeros(0, np.int64)
        return Units(letters, z, z, z)
    new = np.r_[True, (number[1:] != number[:-1]) | (d[1:] != d[:-1])]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(letters)])
    owner = d[start]
    lone = (size > 1) & (size <= SHORT)
    at, n, of = start[lone], size[lone], owner[lone]
    edged = np.full((len(at), SHORT + 2), EDGE, np.uint8)
    for i in range(SHORT):
        edged[:, i + 1] = np.where(i < n, letters[np.minimum(at + i, len(letters) - 1)], EDGE)
    inside = np.arange(SHORT + 2) < (n + 2)[:, None]
    glued = np.r_[False, (size[1:] <= PARTS) & (size[1:] == size[:-1]) & (owner[1:] == owner[:-1])]
    start, owner = start[~glued], owner[~glued]
    size = np.diff(np.r_[start, len(letters)])
    behind = len(letters) + np.cumsum(np.r_[0, (n + 2)[:-1]]) if len(at) else at
    return Units(np.r_[letters, edged[inside]], np.r_[start, behind], np.r_[size, n + 2], np.r_[owner, of])


def hashes(u: Units) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(u.start):
        return np.zeros(0, np.uint64)
    at = np.arange(len(u.codes)) - np.repeat(u.start, u.size)
    h = np.add.reduceat(u.codes * POWERS[at & 4095] + (at >> 12).astype(np.uint64), u.start)
    return h ^ u.size.astype(np.uint64) << np.uint64(56)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes of words, the index of the first of equal ones, and for each word its place among the distinct ones."""
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    return first, place


def all_units(texts: list[str | None], step: int = 100) -> tuple[Units, np.ndarray, list[slice]]:
    """Units of many texts, their hashes and the runs of them that some texts have, made some texts at a time."""
    parts, marks, letters, bounds = [], [], 0, [0]
    for i in range(0, len(texts), step):
        u = units(texts[i : i + step])
        marks.append(hashes(u))
        parts.append(Units(u.codes, (u.start + letters).astype(np.int32), u.size.astype(np.int32), (u.doc + i).astype(np.int32)))
        letters += len(u.codes)
        bounds.append(bounds[-1] + len(u.start))
    columns = {k: [getattr(p, k) for p in parts] for k in ("codes", "start", "size", "doc")}
    del parts
    joined = Units(*[np.concatenate(columns.pop(k)) for k in list(columns)])  # what is joined goes at once
    return joined, np.concatenate(marks), [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


def padded(u: Units, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of words with WINDOW - 1 zeros behind each, and where each starts."""
    size = u.size[which]
    start = np.cumsum(np.r_[0, size[:-1] + WINDOW - 1]) if len(size) else size
    out = np.zeros(int(size.sum()) + (WINDOW - 1) * len(size) + WINDOW, np.uint8)
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start, size) + shift] = u.codes[np.repeat(u.start[which], size) + shift]
    return out, start


def window_scores(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the best score of a window that begins there, and the letters of that window.

    The score of a window is the sum of table values over its subsequences, by the norm of a window so long.
    """
    n = len(codes) - WINDOW
    if n <= 0:
        return np.zeros(0, np.float32), np.zeros(0, np.int8)
    if n > CHUNK:
        parts = [window_scores(codes[i : min(i + CHUNK, n) + WINDOW], table) for i in range(0, n, CHUNK)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    codes = codes.astype(np.int32)
    power = [codes * np.int32(CLASSES ** (ORDER - 1 - i)) for i in range(ORDER)]
    by_span = []
    for b in range(ORDER - 1, WINDOW):
        occ = np.zeros(n + WINDOW, np.float32)
        m = len(codes) - b
        head = power[0][:m] + power[-1][b:]
        for inner in combinations(range(1, b), ORDER - 2):
            ids = head
            for i, a in enumerate(inner):
                ids = ids + power[i + 1][a : a + m]
            occ[:m] += table[ids]
        occ *= DECAY ** (b + 1)
        by_span.append(occ)
    total, best, size = np.zeros(n, np.float32), np.zeros(n, np.float32), np.full(n, ORDER, np.int8)
    for letters in range(ORDER, WINDOW + 1):
        for b in range(ORDER - 1, letters):  # what ends at the last letter; nothing does behind the end of a word
            total += by_span[b - ORDER + 1][letters - 1 - b : letters - 1 - b + n]
        now = total / NORMS[letters]
        whole = codes[letters - 1 : letters - 1 + n] > 0
        better = whole & (now > best) if letters > LEAST else whole  # of a shorter window there are more letters to see
        best[better], size[better] = now[better], letters
    best[codes[:n] == 0] = -1e9  # no window begins behind a word
    return best, size


def word_scores(u: Units, which: np.ndarray, table: np.ndarray) -> np.ndarray:
    codes, start = padded(u, which)
    s, _ = window_scores(codes, table)
    return np.maximum.reduceat(s, start) if len(start) else s




def subsequences(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the subsequences of windows (n x WINDOW codes, 0 behind the end) and their weights, 0 beyond the end."""
    parts = windows[:, PLACES].astype(np.int64)
    ids = parts @ (CLASSES ** np.arange(ORDER - 1, -1, -1))
    w = np.where((parts > 0).all(2), DECAY**SPANS, 0.0)
    return ids, w / NORMS[(windows > 0).sum(1)][:, None]


@dataclass
class Model:
    """``table``: weight of each subsequence; a document's score is 1 / (1 + exp(-(a * worst + b)))."""

    table: np.ndarray
    a: float = 1.0
    b: float = 0.0
    info: dict = field(default_factory=dict)

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The largest window score of each text; 0, that of a window without subsequences, where there is no word."""
        u = units(texts)
        first, place = distinct(hashes(u))
        out = np.zeros(len(texts), np.float32)
        if len(first):
            s = word_scores(u, first, self.table)[place]
            out[u.doc] = -np.inf
            np.maximum.at(out, u.doc, s)
        return out

    def bent(self, text: str, rng: np.random.Generator) -> float:
        """The middle score of the worst window of a text with a letter put in or left out."""
        u = units([text])
        codes, start = padded(u, distinct(hashes(u))[0])
        s, letters = window_scores(codes, self.table)
        at = np.array([int(np.argmax(s))])
        made, _ = gapped(_windows_at(codes, at, letters[at]), np.ones(1), np.arange(1, 27), rng)
        ids, w = subsequences(made)
        return float(np.median((self.table[ids] * w).sum(1))) if len(made) else 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.worst(texts).astype(float) + self.b, -50, 50)))


def _grams(u: Units, part: slice, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and word of each n letters of some words."""
    start, size = u.start[part], u.size[part]
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    codes = u.codes[start[0] : start[-1] + size[-1]]
    m = max(0, len(codes) - n + 1)
    h = np.zeros(m, np.int64)
    for j in range(n):
        h *= 64
        h += codes[j : j + m]
    word = np.repeat(np.arange(part.start, part.stop, dtype=np.int32), size)
    ok = word[:m] == word[n - 1 :]
    return (np.flatnonzero(ok) + start[0]).astype(np.int32), h[ok], word[:m][ok]


def _pairs(u: Units, part: slice, n: int, label: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, document) of the documents of one kind, each once."""
    _, h, word = _grams(u, part, n)
    d = u.doc[word]
    sel = label[d] == kind
    return _unique_pairs(h[sel], d[sel]) if sel.any() else (h[:0], d[:0])


def _cover(u: Units, parts: list[slice], label: np.ndarray, sizes=(4, 5, 6)) -> list[tuple[int, np.ndarray]]:
    """Letter n-grams that few clean documents hold, in the order of what they add; (n, places in words of toxic documents).

    First grams of ``SURE`` toxic documents and more, greedily by the words they add; then rarer ones too, by the documents
    they add. ``parts`` are runs of words that hold whole documents. Either goes on until no gram adds ``FEW``, however many grams that takes and small a share that is.
    """
    pos, neg = label.sum(), (label == 0).sum()
    toxic = label[u.doc] == 1
    found, holds, docs = [], [], []
    for n in sizes:
        # (gram, document) pairs of some documents at a time; first of toxic ones, then of clean ones what toxic ones hold often
        seen = [_pairs(u, part, n, label, 1) for part in parts]
        names, p = np.unique(np.concatenate([h for h, _ in seen]), return_counts=True) if seen else (np.zeros(0, np.int64), np.zeros(0, int))
        names, p = names[p >= FEW], p[p >= FEW]
        if not len(names):
            continue
        q = np.zeros(len(names))
        for part in parts:
            h, _ = _pairs(u, part, n, label, 0)
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            q += np.bincount(at[names[at] == h], minlength=len(names))
        good = names[p / pos > 20 * (q + 0.1) / neg]
        if not len(good):
            continue
        hits = []
        for part in parts:
            at, h, w = _grams(u, part, n)
            g = np.minimum(np.searchsorted(good, h), len(good) - 1)
            sel = (good[g] == h) & toxic[w]
            hits.append((g[sel], at[sel], w[sel]))
        g, at, w = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(g, kind="stable")
        bounds = np.searchsorted(g[order], np.arange(1, len(good)))
        for places, words in zip(np.split(at[order], bounds), np.split(w[order], bounds), strict=True):
            found.append((n, places))
            holds.append(np.unique(words))
            docs.append(np.unique(u.doc[holds[-1]]))
    chosen: list[int] = []

    def greedy(of: list[np.ndarray], left: np.ndarray, ok: np.ndarray) -> None:
        gain = np.array([left[x].sum() if k else 0 for x, k in zip(of, ok, strict=True)])
        while len(gain) and gain.max() >= FEW:
            i = int(np.argmax(gain))
            now = int(left[of[i]].sum())
            if now < gain[i]:  # lazily, since gains only fall
                gain[i] = now
                continue
            chosen.append(i)
            left[of[i]] = False
            gain[i] = 0

    many = np.array([len(d) for d in docs])
    greedy(holds, toxic.copy(), many >= SURE)
    left = label == 1
    for i in chosen:
        left[docs[i]] = False
    greedy(docs, left, many >= FEW)
    return [found[i] for i in chosen]


def _unique_pairs(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    return h[new], d[new]


def _counted(windows: np.ndarray, weight: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    names, inv = np.unique(windows, axis=0, return_inverse=True)
    return names, np.bincount(inv.ravel(), weights=np.broadcast_to(weight, len(windows)), minlength=len(names))


def _windows_at(codes: np.ndarray, at: np.ndarray, letters: np.ndarray | int = WINDOW) -> np.ndarray:
    """Windows of so many letters from places on, with zeros behind."""
    place = np.arange(WINDOW)
    return np.where(place < np.reshape(letters, (-1, 1)), codes[at[:, None] + place], 0).astype(np.int64)


def gapped(windows: np.ndarray, weight: np.ndarray, letters: np.ndarray, rng: np.random.Generator, draws: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Windows with one letter put in, of those that occur, at each inner place, and with one inner letter left out; the
    weight of a window is dealt to what is made of it. A window that grows beyond ``WINDOW`` loses its last letter."""
    out, share = [], []
    for w, c in zip(windows, weight, strict=True):
        n = int((w > 0).sum())
        made = [np.r_[w[:i], x, w[i:]][:WINDOW] for i in range(1, n) for x in rng.choice(letters, draws)]
        if n > ORDER + 1:
            made += [np.r_[w[:i], w[i + 1 :], 0] for i in range(1, n - 1)]
        out += made
        share += [c / len(made)] * len(made)
    return np.array(out, np.int64).reshape(-1, WINDOW), np.array(share)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 3e-4, rounds: int = 40) -> np.ndarray:
    """Linear SVM (squared hinge) by Newton steps on the rows within the margin, halved while they do not help; the last
    column of x is the bias, which is not held small."""
    v = weight / weight.sum()
    ridge = np.r_[np.full(x.shape[1] - 1, reg / 2), 1e-9]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = np.maximum(0, 1 - y * (x @ w))
        return float((v * m * m).sum() + (ridge * w * w).sum()), m > 0

    w = np.zeros(x.shape[1])
    now, inside = loss(w)
    for _ in range(rounds):
        rows, square, side = np.flatnonzero(inside), np.diag(ridge), np.zeros(x.shape[1])
        for i in range(0, len(rows), 2048):  # without copies of all rows
            part = rows[i : i + 2048]
            xa, va = x[part], v[part]
            square += (xa * va[:, None]).T @ xa
            side += xa.T @ (va * y[part])
        wanted = np.linalg.solve(square, side)
        step = 1.0
        while step > 1e-4:
            new = w + step * (wanted - w)
            value, active = loss(new)
            if value <= now:
                break
            step /= 2
        if now - value < 1e-10:
            break
        w, now, inside = new, value, active
    return w


class _Space:
    """Landmarks as dense vectors over the subsequences that any of them has; the last column takes all others."""

    def __init__(self, marks: np.ndarray) -> None:
        ids, w = subsequences(marks)
        self.names = np.unique(ids[w > 0])
        self.column = np.full(CLASSES**ORDER, len(self.names), np.int32)
        self.column[self.names] = np.arange(len(self.names))
        z = np.zeros((len(marks), len(self.names) + 1), np.float32)
        np.add.at(z, (np.repeat(np.arange(len(marks)), ids.shape[1]), self.column[ids].ravel()), w.ravel())
        z[:, -1] = 0
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)
        values, vectors = np.linalg.eigh((z @ z.T).astype(float))
        keep = values > 1e-4
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])
        self.zt = np.ascontiguousarray(z.T)

    def features(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), self.whiten.shape[1] + 1))
        for i in range(0, len(windows), 512):
            ids, w = subsequences(windows[i : i + 512])
            near = [np.einsum("nt,ntm->nm", w[j : j + 64].astype(np.float32), self.zt[self.column[ids[j : j + 64]]], optimize=True) for j in range(0, len(ids), 64)]
            out[i : i + 512, :-1] = np.concatenate(near) @ self.whiten
        out[:, -1] = 1
        return out

    def table(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(CLASSES**ORDER, np.float32)
        out[self.names] = (self.zt @ (self.whiten @ weights))[:-1]
        return out


def fit(
    texts: list[str | None], label: list[int], landmarks: int = 384, rounds: int = 5, seed: int = 7, share: float | None = None, gaps: float = 1.0, stress: float = 10.0,
    clean_words: int = 4000, worst_clean: int = 4, clean_windows: int = 12_000,
) -> Model:
    """Fits the kernel SVM and its calibration; every fourth document is left out of the SVM and calibrates it.

    So that the kernel bridges what is put into an insult, windows with a letter put in or left out are trained beside the
    windows of insults (``gaps`` times their weight), clean windows that come near weigh more (``stress`` times how far they
    are within the margin), and the calibration sees each toxic document's worst window bent in the same ways too.
    What a round trains on is bounded: windows of ``clean_words`` clean words to begin with, then the ``worst_clean`` worst
    words of each clean document, of which the ``clean_windows`` heaviest windows stay.

    ``share`` is that of toxic documents where the model will be used; that of the given ones if it is not known.

    Without toxic or without clean documents nothing can be learnt: every score is then the constant share of toxic ones.
    """
    y = np.array(label, int)
    flat = np.zeros(CLASSES**ORDER, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(flat, 1.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 4 == 3
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    yt = y[~held]
    u, marks, parts = all_units(train)
    del train
    if not len(u.start) or not (yt[u.doc] == 1).any() or not (yt[u.doc] == 0).any():
        return Model(flat, 1.0, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    first, place = distinct(marks)
    place = place.astype(np.int32)
    del marks
    codes, start = padded(u, first)
    # a window of each gram that marks toxic documents, in the words that hold it most often
    grams = _cover(u, parts, yt)
    n_grams = len(grams)
    toxic_word = yt[u.doc] == 1
    ranked: list[list[tuple[int, int, np.ndarray]]] = []
    for n, hit in grams:
        seeds: list[tuple[int, int, np.ndarray]] = []
        word = np.searchsorted(u.start, hit, side="right") - 1  # words are in the order of their letters, without gaps
        for shift in range(WINDOW - n + 2):  # the gram alone; then at the head, in the middle and at the end of a window
            begin = np.maximum(u.start[word], hit - max(0, shift - 1))
            pick, count = np.unique(start[place[word]] + begin - u.start[word], return_counts=True)
            best = np.argsort(-count, kind="stable")[: 2 if shift else 1]
            windows = _windows_at(codes, pick[best], WINDOW if shift else max(n, LEAST))
            seeds += [(int(count[i]) + (0 if shift else len(hit)), len(seeds), w) for i, w in zip(best, windows, strict=True)]
        if seeds:
            ranked.append(sorted(seeds, key=lambda x: (-x[0], x[1])))
    neg_words = np.unique(place[~toxic_word])
    picked = rng.choice(neg_words, min(len(neg_words), clean_words), replace=False)
    clean = _windows_at(codes, start[picked], rng.integers(LEAST, WINDOW + 1, len(picked)))
    # the most frequent window of every gram, in the order of the grams; then second ones and so on, up to a number
    chosen: dict[bytes, tuple[np.ndarray, int]] = {}
    for depth in range(max(map(len, ranked), default=0)):
        for of_gram in ranked:
            if depth < len(of_gram) and (depth == 0 or len(chosen) < 3 * landmarks // 4):
                chosen.setdefault(of_gram[depth][2].tobytes(), (of_gram[depth][2], of_gram[depth][0]))
    if chosen:
        pos, seen = np.array([w for w, _ in chosen.values()]), np.array([c for _, c in chosen.values()], float)
    else:
        pos = np.unique(_windows_at(codes, start[rng.choice(np.unique(place[toxic_word]), 32)]), axis=0)
        seen = np.ones(len(pos))
    whole = ~((pos >= EDGE).any(1))
    parted, parted_seen = gapped(pos[whole], seen[whole], codes[(codes > 0) & (codes < EDGE)][:100_000], rng)
    total = np.zeros(CLASSES**ORDER)
    ids, w = subsequences(pos)
    np.add.at(total, ids.ravel(), w.ravel())
    ids, w = subsequences(clean)
    near = (total[ids] * w).sum(1)
    more = max(16, landmarks - len(pos))
    marks = np.unique(np.concatenate([pos, clean[np.argsort(-near)[: more // 2]], clean[: more // 2]]), axis=0)
    del grams, total, ids, w, near
    release()
    px, nx, pw, nw = np.concatenate([pos, parted]), clean, np.r_[seen, gaps * parted_seen], np.ones(len(clean))
    table, bias = flat, 0.0
    for left in range(rounds - 1, -1, -1):
        space = _Space(marks)
        x = space.features(np.concatenate([px, nx]))
        t = np.r_[np.ones(len(px)), -np.ones(len(nx))]
        wsvm = _svm(x, t, np.r_[pw / pw.sum(), nw / nw.sum()])
        del x
        table, bias = space.table(wsvm[:-1]), float(wsvm[-1])
        s, letters = window_scores(codes, table)
        best = np.maximum.reduceat(s, start)
        behind = np.r_[start[1:], len(s)]

        def peak(words: np.ndarray) -> np.ndarray:
            at = np.array([start[w] + int(np.argmax(s[start[w] : behind[w]])) for w in words], int)  # noqa: B023
            return _windows_at(codes, at, letters[at])  # noqa: B023

        order = np.lexsort((-best[place], u.doc)).astype(np.int32)
        docs = u.doc[order]
        rank = np.arange(len(order), dtype=np.int32) - np.searchsorted(docs, docs).astype(np.int32)
        top = order[(yt[docs] == 1) & (rank == 0)]
        hard = order[(yt[docs] == 0) & (rank < worst_clean)]
        del order, docs, rank
        release()
        if left:  # what no landmark marks yet
            lost, times = _counted(peak(place[top[best[place[top]] + bias < 0]]), 1)
            marks = np.unique(np.concatenate([marks, lost[times >= FEWEST]]), axis=0)
        # the windows that the grams gave stay, so that an insult that never is a document's worst is learnt too
        seeds_weight = SEEDS * len(top) / seen.sum()
        px, pw = _counted(np.concatenate([pos, parted, peak(place[top])]), np.r_[seeds_weight * seen, gaps * seeds_weight * parted_seen, np.ones(len(top))])
        nx, nw = _counted(np.concatenate([nx, peak(place[hard])]), np.r_[nw, 1 + stress * np.maximum(0, 1 + best[place[hard]] + bias)])
        heavy = np.argsort(-nw, kind="stable")[:clean_windows]
        nx, nw = nx[heavy], nw[heavy]
    model = Model(table, info={"grams": n_grams, "landmarks": len(marks), "bias": bias})
    cal = np.flatnonzero(held) if held.any() else np.arange(len(y))
    del u, codes, start, first, place
    worst = np.concatenate([model.worst([texts[i] for i in part]) for part in np.array_split(cal, len(cal) // 50 + 1)])
    bent = np.array([model.bent(texts[i], rng) for i in cal[(y[cal] == 1) & (worst + bias > 0)]] if gaps else [])
    margins, truth = np.r_[worst.astype(float), bent] + bias, np.r_[y[cal], np.ones(len(bent), int)]
    model.a, model.b = labelled.platt(margins, truth, float(y.mean()) if share is None else share)
    model.b += model.a * bias
    return model


def fit_on(docs: DataFrame, labels: DataFrame, most_toxic: int = 1000, most_clean: int = 2000, id_col: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most ``most_toxic`` and ``most_clean`` labelled documents outside of fold 0; that bounds the driver."""
    got = labelled.sample(docs, labels, "toxic", {1: most_toxic, 0: most_clean}, id_col, text)
    try:
        return fit(got.pop("text").tolist(), got["label"].tolist(), share=labelled.share(labels, "toxic", id_col))
    finally:
        release()


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) to every row, from the whole text; null and empty texts have the score of no word.

    Rows are scored where they are, in blocks of Arrow batches: no shuffle, and copies or frequent words need no care.
    """

    def kernel(texts: list[str | None]) -> list:
        return [pa.array(model.score(texts))]

    return map_text(df, text, [T.StructField("score", T.DoubleType())], kernel, keep, block=1 << 19)


def flagged(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
