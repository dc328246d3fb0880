"""Runs of words that repeat with a period, by the linear method of Gusfield and Stoye for tandem repeats.

A block of texts becomes one sequence of word numbers, with a number of its own behind each text. Its suffix tree is held
as a suffix array with the ranks of all factors of 1, 2, 4, ... words: a node is an interval of the array, and a suffix link
goes from the interval of S[i..j] to that of S[i+1..j].

1. Blocks of the Lempel-Ziv factorisation; around each block's ends, extensions in both directions give squares (ww) that
   cover the leftmost occurrence of every kind of square.
2. From each of them suffix links are followed, word by word to the right, as long as the next rotation is a square; the
   nodes that are met are the complete vocabulary of squares.
3. The leaves under a node are the places of its square. Squares of one period at neighbouring places merge into runs.

Only squares whose half is no power are used, so the period of a run is its smallest, and places number O(n log n).
Each step works on arrays of all texts of a block at once.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, map_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPARK_WORD = r"[^\x20\x09-\x0D]+"
NONE = np.zeros((0, 3), np.int64)


class Suffixes:
    """Suffix array and factor ranks of a sequence whose last number stands nowhere else."""

    def __init__(self, s: np.ndarray) -> None:
        self.n = n = len(s)
        order = np.argsort(s, kind="stable")
        fresh = np.r_[True, s[order][1:] != s[order][:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.ranks, width = [rank], 1  # ranks[k][i]: where the suffixes that begin with S[i..i+2^k) begin in the array
        size = np.diff(np.r_[np.flatnonzero(fresh), n])
        live = order[np.repeat(size, size) > 1]
        while len(live):
            after = live + width
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
            key = rank[live].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(key, kind="stable")
            live, key = live[by], key[by]
            first = rank[live].astype(np.int64)
            old = np.r_[True, first[1:] != first[:-1]]
            new = np.r_[True, key[1:] != key[:-1]]
            at = np.arange(len(live))
            rank = rank.copy()
            rank[live] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
            self.ranks.append(rank)
            width *= 2
            size = np.diff(np.r_[np.flatnonzero(new), len(live)])
            live = live[np.repeat(size, size) > 1]
        self.place = rank  # of each suffix in the array
        self.array = np.empty(n, np.int32)
        self.array[rank] = np.arange(n, dtype=np.int32)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at ``a`` and at ``b``, which differ."""
        a, b, out = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, inside = self.ranks[k], np.maximum(a, b) < self.n
            same = inside & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])
            step = same.astype(np.int64) << k
            a, b, out = a + step, b + step, out + step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common suffixes of what ends before ``a`` and before ``b``, which differ."""
        a, b, out = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, w = self.ranks[k], 1 << k
            inside = np.minimum(a, b) >= w
            same = inside & (rank[np.maximum(a - w, 0)] == rank[np.maximum(b - w, 0)])
            step = same.astype(np.int64) << k
            a, b, out = a - step, b - step, out + step
        return out

    def previous_factor(self) -> np.ndarray:
        """For each place the length of the longest factor that also begins at an earlier place."""
        earlier = np.full((2, self.n), -1, np.int64)  # nearest in the array, before and behind, that is earlier in the text
        for side, line in ((0, range(self.n)), (1, range(self.n - 1, -1, -1))):
            stack: list[int] = []
            out, array = [-1] * self.n, self.array.tolist()
            for r in line:
                i = array[r]
                while stack and stack[-1] > i:
                    stack.pop()
                if stack:
                    out[i] = stack[-1]
                stack.append(i)
            earlier[side] = out
        best, at = np.zeros(self.n, np.int64), np.arange(self.n)
        for e in earlier:
            known = np.flatnonzero(e >= 0)
            best[known] = np.maximum(best[known], self.forward(at[known], e[known]))
        return best

    def neighbours(self) -> np.ndarray:
        """lcp[r]: the common prefix of the suffixes at r - 1 and r of the array."""
        return np.r_[0, self.forward(self.array[:-1], self.array[1:])]


def lz_blocks(previous: np.ndarray) -> np.ndarray:
    """Starts of the blocks, and the end."""
    starts, i, step = [], 0, np.maximum(previous, 1).tolist()
    while i < len(step):
        starts.append(i)
        i += step[i]
    return np.array([*starts, len(step)], np.int64)


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[j], first[j] + 1, ... (``count[j]`` of them) for each j, and the j of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def covering_squares(s: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares such that the leftmost occurrence of each kind of square is one of them or is reached from
    one by steps to the right over squares of the same half."""
    edges = lz_blocks(suffixes.previous_factor())
    h, h1 = edges[:-1], edges[1:]
    found = []
    # the centre in the block and the end behind it: halves up to the block's length, seen from the next block's start
    inner = np.flatnonzero(h1 < len(s))
    k, b = spread(np.ones(len(inner), np.int64), (h1 - h)[inner])
    end = h1[inner][b]
    q = end - k
    met = np.flatnonzero(s[q] == s[end])
    k, end, q = k[met], end[met], q[met]
    right, left = suffixes.forward(q, end), suffixes.backward(q, end)
    ok = right + left >= k
    found.append((np.maximum(q - left, q - k + 1)[ok], k[ok]))
    # the start before the block and the centre in it
    behind = np.r_[(h1 - h)[1:], 0]
    k, b = spread(np.ones(len(h), np.int64), h1 - h + behind)
    q = h[b] + k
    met = np.flatnonzero((q < len(s)) & (h[b] > 0))
    met = met[(s[q[met]] == s[h[b[met]]]) & (s[q[met] - 1] == s[h[b[met]] - 1])]
    k, b, q = k[met], b[met], q[met]
    start = h[b]
    right, left = suffixes.forward(start, q), suffixes.backward(start, q)
    first = np.maximum(start - left, start - k + 1)
    ok = (right + left >= k) & (first + k <= h1[b])
    found.append((first[ok], k[ok]))
    starts, halves = (np.concatenate(x) for x in zip(*found, strict=True))
    key = np.unique(starts * (len(s) + 1) + halves)
    return key // (len(s) + 1), key % (len(s) + 1)


def no_powers(suffixes: Suffixes, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Which squares have a half that is no power of a shorter word."""
    good, rest, prime = np.ones(len(half), bool), half.copy(), 2
    while prime * prime <= (rest.max() if len(rest) else 0):
        hit = np.flatnonzero(rest % prime == 0)
        if len(hit):
            root = half[hit] // prime
            good[hit] &= suffixes.forward(start[hit], start[hit] + root) < 2 * half[hit] - root
            while len(hit):
                rest[hit] //= prime
                hit = hit[rest[hit] % prime == 0]
        prime += 1
    hit = np.flatnonzero(rest > 1)
    root = half[hit] // rest[hit]
    good[hit] &= suffixes.forward(start[hit], start[hit] + root) < 2 * half[hit] - root
    return good


class Intervals:
    """Nodes of the suffix tree: the widest interval of the array around a suffix in which a length is common."""

    def __init__(self, lcp: np.ndarray) -> None:
        self.n, self.least = len(lcp), [lcp]
        while (w := 1 << (len(self.least) - 1)) * 2 <= self.n:
            last = self.least[-1]
            self.least.append(np.minimum(last[: len(last) - w], last[w:]))

    def around(self, r: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = r.astype(np.int64), r.astype(np.int64) + 1
        for k in range(len(self.least) - 1, -1, -1):
            w, table = 1 << k, self.least[k]
            can = low >= w  # lcp[low - w + 1 .. low] joins them
            ok = can & (table[np.clip(low - w + 1, 0, len(table) - 1)] >= length)
            low = np.where(ok, low - w, low)
            can = high + w <= self.n
            ok = can & (table[np.clip(high, 0, len(table) - 1)] >= length)
            high = np.where(ok, high + w, high)
        return low, high


def runs_of(s: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of at least two periods, by start and period.

    The last number of ``s`` stands nowhere else; numbers that stand once never belong to a run.
    """
    if len(s) < 3:
        return NONE
    suffixes = Suffixes(s)
    start, half = covering_squares(s, suffixes)
    good = no_powers(suffixes, start, half)
    start, half = start[good], half[good]
    if not len(start):
        return NONE
    # suffix links: S[i..i+2k) to S[i+1..], on while the word that leaves at the left comes in at the right
    more = suffixes.forward(start, start + half) - half
    at, owner = spread(start, more + 1)
    half = half[owner]
    low, high = Intervals(suffixes.neighbours()).around(suffixes.place[at], 2 * half)
    node, pick = np.unique(low * (len(s) + 1) + half, return_index=True)
    half, low, high = half[pick], low[pick], high[pick]
    # every leaf under a node is a place of its square
    leaf, owner = spread(low, high - low)
    place, half = suffixes.array[leaf].astype(np.int64), half[owner]
    by = np.lexsort((place, half))
    place, half = place[by], half[by]
    begins = np.flatnonzero(np.r_[True, (half[1:] != half[:-1]) | (place[1:] != place[:-1] + 1)])
    ends = np.r_[begins[1:], len(place)] - 1
    out = np.stack([place[begins], place[ends] - place[begins] + 2 * half[begins], half[begins]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def may_have_runs(numbers: np.ndarray, text: np.ndarray, least: int, weight: np.ndarray) -> np.ndarray:
    """The texts in which some ``least // 2`` words in a row come again: all others have no run of ``least`` words.

    A run of ``length >= max(least, 2 * period)`` has at least half of ``least`` words in a row that are each equal to the
    word a period later. Sums of random weights stand for the words; where two agree by chance, a text is looked at for
    nothing.
    """
    w = max(1, least // 2)
    if len(numbers) < w:
        return np.zeros(0, np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(numbers) - w + 1, np.uint64)
    for j in range(w):
        h = h * odd + weight[numbers[j : len(numbers) - w + 1 + j]]
    inside = text[: len(h)] == text[w - 1 :]
    h, t = (h ^ (text[: len(h)].astype(np.uint64) * odd))[inside], text[: len(h)][inside]
    by = np.argsort(h)
    twin = h[by][1:] == h[by][:-1]
    return np.unique(t[by[1:][twin]])


def runs_of_texts(words: list[list[str]], least: int = 12) -> list[np.ndarray]:
    """The runs of at least ``least`` words and of two periods of each text."""
    out, known = [NONE] * len(words), {}
    counts = np.array([len(w) for w in words], np.int64)
    number = np.array([known.setdefault(x, len(known)) for w in words for x in w], np.int64)
    text = np.repeat(np.arange(len(words)), counts)
    weight = np.frombuffer(random.Random(7).randbytes(8 * max(len(known), 1)), np.uint64)
    chosen = may_have_runs(number, text, least, weight)
    if not len(chosen):
        return out
    first = np.cumsum(counts) - counts
    parts, starts, at = [], [], 0
    for i, t in enumerate(chosen):
        starts.append(at)
        parts += [number[first[t] : first[t] + counts[t]], [len(known) + i]]
        at += counts[t] + 1
    found = runs_of(np.concatenate(parts))
    found = found[found[:, 1] >= least]
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(chosen) + 1))
    for i, t in enumerate(chosen):
        own = found[cuts[i] : cuts[i + 1]].copy()
        own[:, 0] -= starts[i]
        out[t] = own
    return out


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def find_runs(df: DataFrame, text: str = "text", least: int = 12, keep: list[str] | None = None, block: int = 1 << 20) -> DataFrame:
    """Adds n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are what stands between white space of ASCII. A run is a stretch of words in which words ``period`` apart are
    identical, ``period`` being the smallest such number, of at least ``least`` words and two periods, that no neighbouring
    word extends. ``collapsed`` has the words that stand in no run, or within the first period of each run that holds them,
    with one space between. Null and texts without words have no runs and an empty ``collapsed``; columns of ``df`` with
    these names give way. Texts are worked on in blocks of about ``block`` bytes, whole; memory is about 300 bytes for each
    word of a block, or of its one text if that is longer.
    """

    def kernel(texts: list[str | None]) -> list:
        words = [WORD.findall(t) if t else [] for t in texts]
        kept = []
        runs = runs_of_texts(words, least)
        for w, found in zip(words, runs, strict=True):
            if len(found):
                depth = np.zeros(len(w) + 1, np.int64)
                np.add.at(depth, found[:, 0] + found[:, 2], 1)
                np.add.at(depth, found[:, 0] + found[:, 1], -1)
                w = [w[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
            kept.append(" ".join(w))
        flat = np.concatenate([NONE, *runs])
        offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], names=["start", "length", "period"])
        return [[len(w) for w in words], pa.ListArray.from_arrays(pa.array(offsets), struct), kept]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return map_text(df, text, fields, kernel, keep, block)


def with_planted_period(text: Column, h: Column, every: int = 10) -> Column:
    """Where ``h`` is divisible by ``every``, the words from a place that ``h`` chooses repeat with a period it chooses:
    with g = h // every, a = g mod n and p = 1 + (n - a) // (3 + g mod 8), word i >= a becomes word a + (i - a) mod p."""
    g = F.floor(h / every)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return let(F.struct(w.alias("w"), n.alias("n"), a.alias("a"), p.alias("p")), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("bigint"), x["n"] - 1), lambda i: F.get(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "))

    words = F.regexp_extract_all(text, F.lit(SPARK_WORD), F.lit(0))
    some = (h % every == 0) & text.rlike(SPARK_WORD)
    return F.when(some, let(words, planted)).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (of equals the first, then the shortest period), and sha256 of runs and of what is left."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select(id_col, F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.shortness")
    return rows.select(id_col, "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
