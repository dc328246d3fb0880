"""Transforms of whole signals whose samples are rows: a Fourier transform in rows and columns, and blocks with surroundings.

A transform of N = n1 * n2 values sees them as a matrix of n1 rows. One exchange brings columns together for transforms of
n1 values, which are turned by the twiddle factors; a second one brings rows together for transforms of n2. No group holds
more than ``limit`` values. Signals of up to ``limit`` values go through at once; of those that are long beside ``limit`` a
row is a transform by rows and columns again, with one exchange more to bring numbers together. Where no factors fit (a large
prime), the transform becomes a convolution with a chirp at a power of two.

Between transforms a signal is in pieces: (signal_id, first, re, im) with the values from number ``first`` on. More columns
may be part of the key, as the number of a band.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp, transforms
from ..functions.dsp import next_pow2
from ..meta import SpecMeta, Stage
from ..shared import cut, small
from .arrays import lists, ragged
from .blocks import affine, affine_at, in_blocks, map_blocks, ordered, scan
from .spectral import istft

LIMIT = 1 << 20
#: Values that pieces have which leave a kernel together.
HELD = 1 << 18
Vector = np.ndarray
PIECE = "first bigint, re array<double>, im array<double>"


def factors(n: int, limit: int) -> tuple[int, int] | None:
    """(n1, n2) with n1 * n2 = n and both at most ``limit``, as near to each other as can be; (1, n) where that is enough."""
    if n <= limit:
        return 1, n
    for d in range(math.isqrt(n), max(n // limit, 2) - 1, -1):
        if n % d == 0 and n // d <= limit:
            return d, n // d
    return None


@lru_cache(1 << 12)
def steps(n: int, limit: int) -> int:
    """What a transform of ``n`` values takes: 0 for two steps, -1 for a chirp, else the factor its rows are dealt by.

    Two steps hand on tiles of limit^2 / n values, so from limit^1.5 on there are more of them.
    """
    if n <= limit or n * n <= limit**3 and factors(n, limit):
        return 0
    rest, d = n, 2
    while rest > limit and d * d <= rest and d <= limit:
        while rest % d == 0:
            rest //= d
        d += 1
    if rest > limit:
        return 0 if factors(n, limit) else -1
    root = max(2, math.isqrt(limit))
    return next((d for d in [*range(root, 1, -1), *range(root + 1, limit + 1)] if n % d == 0), -1)


def sizes_of(rows: DataFrame, n: str = "n") -> DataFrame:
    """(signal_id, size) of signals in rows."""
    return cut(rows.groupBy("signal_id").agg((F.max(n) + 1).cast("bigint").alias("size")))


def pieces_of(rows: DataFrame, length: int = 4096, x: str = "x") -> DataFrame:
    """Pieces of up to ``length`` samples from rows (signal_id, n, x)."""

    def gather(key, t):
        n, v = ordered(t, "n", x)
        return pa.table([pa.array([key[0].as_py()]), pa.array([int(n[0])], pa.int64()), ragged([v]), ragged([np.zeros(len(v))])], names=["signal_id", "first", "re", "im"])

    return in_blocks(rows.select("signal_id", "n", F.col(x)), length).groupBy("signal_id", "block").applyInArrow(gather, f"signal_id string, {PIECE}")


def rows_of(pieces: DataFrame, n: str = "n") -> DataFrame:
    """Rows (key, n, re, im) of pieces."""
    keys = [c for c in pieces.columns if c not in ("first", "re", "im")]
    got = pieces.select(*keys, "first", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    return got.select(*keys, (F.col("first") + F.col("i")).alias(n), "z.re", "z.im")


def _column(t: pa.Table, name: str) -> Vector:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _starts(t: pa.Table, name: str) -> tuple[Vector, Vector]:
    """Offsets and lengths of the lists of a column."""
    size = t.column(name).combine_chunks().value_lengths().to_numpy()
    return np.cumsum(size) - size, size


def map_pieces(pieces: DataFrame, f: Callable[[Vector, int, Vector], Vector | list[tuple[int, Vector]]], size: str = "size", band: bool = False) -> DataFrame:
    """``f(numbers, size, values)`` of each piece that has a column ``size``; with ``band`` it gives (band, values) pairs,
    which become pieces of their own."""
    keys = [c for c in pieces.columns if c not in ("first", "re", "im")]
    schema = ", ".join([*(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in keys), *["band int"] * band, PIECE])

    def run(batches):
        for b in batches:
            at = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            off = np.r_[0, np.cumsum(at["re"].value_lengths().to_numpy())]
            re, im = at["re"].flatten().to_numpy(), at["im"].flatten().to_numpy()
            out, owner, held = [], [], 0

            def batch():
                take = pa.array(owner, pa.int64())
                return pa.RecordBatch.from_arrays([*(at[k].take(take) for k in keys), *([pa.array([n for n, _ in out], pa.int32())] if band else []), at["first"].take(take), ragged([v.real for _, v in out]), ragged([v.imag for _, v in out])], names=[*keys, *["band"] * band, "first", "re", "im"])  # noqa: B023

            for i, (first, n) in enumerate(zip(at["first"].to_pylist(), at[size].to_pylist(), strict=True)):
                z = re[off[i] : off[i + 1]] + 1j * im[off[i] : off[i + 1]]
                made = f(np.arange(first, first + len(z)), n, z)
                for number, v in made if band else [(None, made)]:
                    out.append((number, np.asarray(v, complex)))
                    owner.append(i)
                    held += len(out[-1][1])
                    if held >= HELD:
                        yield batch()
                        out, owner, held = [], [], 0
            if out:
                yield batch()

    return pieces.mapInArrow(run, schema)


def fft(pieces: DataFrame, sizes: DataFrame, inverse: bool = False, limit: int | None = None) -> DataFrame:
    """The discrete Fourier transform of pieces, as pieces with a column ``size``; the inverse is divided by the size.

    ``sizes`` is (signal_id, size). Exact for any size, in two exchanges, and two more for each time that rows are still
    long; three transforms of a power of two for sizes without fitting factors.
    """
    limit = limit or LIMIT
    pieces = pieces.drop("size")
    known = sizes.select("signal_id", "size", _steps("size", limit).alias("by"))
    kinds = {r[0] for r in known.select(F.signum("by")).distinct().collect()} or {0}  # at most three
    parts = {
        0: lambda: _two_steps(pieces.join(small(known.where("by = 0").drop("by")), "signal_id"), inverse, limit),
        1: lambda: _more_steps(pieces, known.where("by > 0"), inverse, limit),
        -1: lambda: _chirped(pieces, known.where("by < 0").drop("by"), inverse, limit),
    }
    return reduce(DataFrame.unionByName, [parts[k]() for k in sorted(kinds)])


def _steps(c: str, limit: int):
    @F.pandas_udf("bigint")
    def by(n):
        return n.map(lambda v: steps(int(v), limit))

    return by(F.col(c))


def _cut(pieces: DataFrame, keys: list[str], part: Callable[[int, int], tuple[int, int]], more: list[str]) -> DataFrame:
    """Pieces with a column ``c``, cut where ``part(number, *more)`` says: it gives c and the end of what shares it."""
    schema = ", ".join([*(f"{k} {pieces.schema[k].dataType.simpleString()}" for k in [*keys, *more]), "c bigint", PIECE])

    def run(batches):
        for b in batches:
            out, owner = [], []
            at = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            off = np.r_[0, np.cumsum(at["re"].value_lengths().to_numpy())]
            re, im = at["re"].flatten().to_numpy(), at["im"].flatten().to_numpy()
            for i, (first, *known) in enumerate(zip(at["first"].to_pylist(), *(at[c].to_pylist() for c in more), strict=True)):
                end, n = first + int(off[i + 1] - off[i]), first
                while n < end:
                    c, stop = part(n, *known)
                    stop = min(end, stop)
                    s = slice(int(off[i]) + n - first, int(off[i]) + stop - first)
                    out.append((c, n, re[s], im[s]))
                    owner.append(i)
                    n = stop
            if out:
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([*(at[k].take(take) for k in [*keys, *more]), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), ragged([x[2] for x in out]), ragged([x[3] for x in out])], names=[*keys, *more, "c", "first", "re", "im"])

    return pieces.select(*keys, *more, "first", "re", "im").mapInArrow(run, schema)


def _by_group(df: DataFrame, by: list[str], kernel: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``groupBy(by).applyInArrow(kernel)`` gives, with the groups of a task in one stream: groups here are small and
    many, and a stream for each would take longer than the transforms."""

    def run(batches):
        key, held, made, size = None, [], [], 0
        done = lambda: kernel(key, pa.Table.from_batches(held))
        for b in batches:
            at = [b.column(b.schema.get_field_index(c)) for c in by]
            codes = [(a.dictionary_encode().indices if pa.types.is_string(a.type) else a).to_numpy() for a in at]
            edge = np.flatnonzero(np.r_[b.num_rows > 0, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows], strict=True):
                now = tuple(a[lo] for a in at)
                if held and now != key:
                    made.append(done())
                    size, held = size + made[-1].nbytes, []
                    if size >= 16 * HELD:
                        yield from pa.concat_tables(made).combine_chunks().to_batches()
                        made, size = [], 0
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            made.append(done())
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _more_steps(pieces: DataFrame, sizes: DataFrame, inverse: bool, limit: int) -> DataFrame:
    """As ``_two_steps`` for sizes (signal_id, size, by) whose rows, ``by`` in number, are too long for a group."""
    keys = [c for c in pieces.columns if c not in ("first", "re", "im")]
    named = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in keys)
    sign = 2j * np.pi if inverse else -2j * np.pi
    sizes = small(sizes)

    def column(n: int, size: int, by: int) -> tuple[int, int]:
        width, n2 = max(1, limit // by), size // by
        col = n % n2
        return col // width, n - col + min(n2, (col // width + 1) * width)

    def repeated(key, t: pa.Table, n: int) -> list[pa.Array]:
        return [pa.array([k.as_py()] * n, f.type) for k, f in zip(key[:-1], t.schema, strict=False)]

    def columns(key, t):
        size, by, c = t.column("size")[0].as_py(), t.column("by")[0].as_py(), key[-1].as_py()
        n2, width = size // by, max(1, limit // by)
        lo, hi = c * width, min(n2, (c + 1) * width)
        m = np.zeros((by, hi - lo), complex)
        start, length = _starts(t, "re")
        re, im = _column(t, "re"), _column(t, "im")
        for first, s, k in zip(t.column("first").to_pylist(), start, length, strict=True):
            row, col = divmod(first, n2)
            m[row, col - lo : col - lo + k] = re[s : s + k] + 1j * im[s : s + k]
        m = np.fft.ifft(m, axis=0) if inverse else np.fft.fft(m, axis=0)
        m *= np.exp(sign * ((np.arange(by)[:, None] * np.arange(lo, hi)) % size) / size)
        return pa.table([*repeated(key, t, by), pa.array(range(by), pa.int64()), pa.array([lo] * by, pa.int64()), lists(m.real), lists(m.imag)], names=[*keys, "k1", "first", "re", "im"])

    dealt = _cut(pieces.join(sizes, "signal_id"), keys, column, ["size", "by"])
    rows = _by_group(dealt, [*keys, "c"], columns, f"{named}, k1 bigint, {PIECE}")
    # the names of levels below: a signal that is dealt again has rows of rows
    deep = f"k{1 + sum(c.startswith('__k') for c in keys)}"
    inner = sizes.select("signal_id", (F.col("size") / F.col("by")).cast("bigint").alias("size"))
    made = fft(rows.withColumnRenamed("k1", f"__{deep}"), inner, inverse, limit).drop("size")

    def block(n: int, size: int, by: int) -> tuple[int, int]:
        width = max(1, limit // by)
        return n // width, (n // width + 1) * width

    def together(key, t):
        size, by, c = t.column("size")[0].as_py(), t.column("by")[0].as_py(), key[-1].as_py()
        width = max(1, limit // by)
        lo, hi = c * width, min(size // by, (c + 1) * width)
        m = np.zeros((hi - lo, by), complex)
        start, length = _starts(t, "re")
        re, im = _column(t, "re"), _column(t, "im")
        for k1, first, s, k in zip(t.column(f"__{deep}").to_pylist(), t.column("first").to_pylist(), start, length, strict=True):
            m[first - lo : first - lo + k, k1] = re[s : s + k] + 1j * im[s : s + k]
        return pa.table([*repeated(key, t, 1), pa.array([size], pa.int64()), pa.array([lo * by], pa.int64()), ragged([m.real.ravel()]), ragged([m.imag.ravel()])], names=[*keys, "size", "first", "re", "im"])

    dealt = _cut(made.join(sizes, "signal_id"), [*keys, f"__{deep}"], block, ["size", "by"])
    out = _by_group(dealt, [*keys, "c"], together, f"{named}, size bigint, {PIECE}")
    return cut(out) if deep == "k1" else out  # else plans of several transforms grow large on the driver


def _two_steps(pieces: DataFrame, inverse: bool, limit: int) -> DataFrame:
    keys = [c for c in pieces.columns if c not in ("first", "re", "im", "size")]
    kinds = [f"{c} {pieces.schema[c].dataType.simpleString()}" for c in keys]
    sign = 2j * np.pi if inverse else -2j * np.pi

    def column(n: int, size: int) -> tuple[int, int]:  # pieces are cut where the row or the block of columns changes
        n1, n2 = factors(size, limit)
        width, col = max(1, limit // n1), n % n2
        return col // width, n - col + min(n2, (col // width + 1) * width)

    def columns(key, t):
        size, c = t.column("size")[0].as_py(), key[-1].as_py()
        n1, n2 = factors(size, limit)
        width = max(1, limit // n1)
        lo, hi = c * width, min(n2, (c + 1) * width)
        m = np.zeros((n1, hi - lo), complex)
        start, length = _starts(t, "re")
        re, im = _column(t, "re"), _column(t, "im")
        for first, s, k in zip(t.column("first").to_pylist(), start, length, strict=True):
            row, col = divmod(first, n2)
            m[row, col - lo : col - lo + k] = re[s : s + k] + 1j * im[s : s + k]
        m = np.fft.ifft(m, axis=0) * n1 if inverse else np.fft.fft(m, axis=0)
        k1, col = np.arange(n1)[:, None], np.arange(lo, hi)
        m *= np.exp(sign * ((k1 * col) % size) / size)
        high = max(1, limit // n2)
        tiles = [m[r : r + high].ravel() for r in range(0, n1, high)]
        return pa.table([*(pa.array([k.as_py()] * len(tiles), f.type) for k, f in zip(key[:-1], t.schema, strict=False)), pa.array([size] * len(tiles), pa.int64()), pa.array(range(len(tiles)), pa.int64()), pa.array([c] * len(tiles), pa.int64()), ragged([v.real for v in tiles]), ragged([v.imag for v in tiles])], names=[*keys, "size", "r", "c", "re", "im"])

    def rows(key, t):
        size, r = t.column("size")[0].as_py(), key[-1].as_py()
        n1, n2 = factors(size, limit)
        width, high = max(1, limit // n1), max(1, limit // n2)
        count = min(high, n1 - r * high)
        m = np.zeros((count, n2), complex)
        start, length = _starts(t, "re")
        re, im = _column(t, "re"), _column(t, "im")
        for c, s, k in zip(t.column("c").to_pylist(), start, length, strict=True):
            m[:, c * width : c * width + k // count] = (re[s : s + k] + 1j * im[s : s + k]).reshape(count, -1)
        m = np.fft.ifft(m, axis=1) * n2 / size if inverse else np.fft.fft(m, axis=1)
        if n1 == 1:  # one run of numbers
            first, flat = [0], [m[0]]
            re, im = ragged([m[0].real]), ragged([m[0].imag])
        else:
            first, flat = (r * high + n1 * np.arange(n2)).tolist(), m.T
            re, im = lists(flat.real), lists(flat.imag)
        n = len(first)
        return pa.table([*(pa.array([k.as_py()] * n, f.type) for k, f in zip(key[:-1], t.schema, strict=False)), pa.array([size] * n, pa.int64()), pa.array(first, pa.int64()), re, im], names=[*keys, "size", "first", "re", "im"])

    named = ", ".join(kinds)
    dealt = _cut(pieces, keys, column, ["size"])
    tiles = _by_group(dealt, [*keys, "c"], columns, f"{named}, size bigint, r bigint, c bigint, re array<double>, im array<double>")
    return _by_group(tiles, [*keys, "r"], rows, f"{named}, size bigint, {PIECE}")


def chirp(n: Vector, size: int) -> Vector:
    """exp(-i pi n^2 / size), with the square taken modulo 2 * size in whole numbers."""
    n = n.astype(object) if size > 1 << 31 else n.astype(np.int64)
    return np.exp(-1j * np.pi * ((n * n) % (2 * size)).astype(float) / size)


def _chirped(pieces: DataFrame, sizes: DataFrame, inverse: bool, limit: int) -> DataFrame:
    """Bluestein's transform: products with a chirp before and behind a convolution with it, at a power of two."""
    spark = pieces.sparkSession
    powers = cut(sizes.select("signal_id", F.col("size").alias("n"), F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.col("size") - 1))).cast("bigint").alias("size")))
    around = small(powers.withColumnRenamed("size", "m"))
    keys = [c for c in pieces.columns if c not in ("first", "re", "im")]
    turn = np.conj if inverse else lambda z: z
    left = map_pieces(pieces.join(around, "signal_id"), lambda k, n, z: turn(z) * chirp(k, n), "n").drop("n", "m")
    a = fft(left, powers.select("signal_id", "size"), limit=limit)
    # the kernel: conj(chirp) at 0 .. n - 1 and, from the end, at -1 .. 1 - n; each distinct size once
    step = 4096
    distinct = powers.select("n", "size").distinct()
    spans = distinct.select("n", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / step))).alias("i"))
    spans = spans.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "n", "i")

    def kernel(batches):
        for b in batches:
            for n, m, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = np.arange(i * step, min(m, (i + 1) * step))
                away = np.minimum(k, m - k)
                v = np.where(away < n, np.conj(chirp(away, n)), 0)
                yield pa.RecordBatch.from_arrays([pa.array([str(n)]), pa.array([i * step], pa.int64()), ragged([v.real]), ragged([v.imag])], names=["signal_id", "first", "re", "im"])

    b = fft(spans.select("n", "size", "i").mapInArrow(kernel, f"signal_id string, {PIECE}"), distinct.select(F.col("n").cast("string").alias("signal_id"), "size"), limit=limit)
    b = b.select(F.col("signal_id").cast("bigint").alias("n"), "first", F.col("re").alias("bre"), F.col("im").alias("bim"))
    joined = a.join(around.select("signal_id", "n"), "signal_id").join(b, ["n", "first"])  # both came out of the same layout
    re = F.zip_with(F.zip_with("re", "bre", lambda x, y: x * y), F.zip_with("im", "bim", lambda x, y: x * y), lambda x, y: x - y)
    im = F.zip_with(F.zip_with("re", "bim", lambda x, y: x * y), F.zip_with("im", "bre", lambda x, y: x * y), lambda x, y: x + y)
    c = fft(joined.select(*keys, "first", re.alias("re"), im.alias("im")), powers.select("signal_id", "size"), inverse=True, limit=limit)
    c = c.drop("size").join(around.select("signal_id", F.col("n").alias("size")), "signal_id").where("first < size")
    share = (lambda n: n) if inverse else (lambda n: 1)
    out = map_pieces(c, lambda k, n, z: (turn(z * chirp(k, n)) / share(n))[k < n])
    return out.select(*keys, "size", "first", "re", "im")


# ---- what is made of the whole spectrum ----


def analytic(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(signal_id, n, re, im): the analytic signal of each signal in rows."""
    sizes = sizes_of(rows)
    gain = lambda k, n, z: z * np.where((k == 0) | (2 * k == n), 1, np.where(2 * k < n, 2, 0))
    return rows_of(fft(map_pieces(fft(pieces_of(rows), sizes, limit=limit), gain), sizes, True, limit).drop("size"))


def bands(rows: DataFrame, responses: Callable[[Vector, int], list[tuple[int, Vector]]], limit: int | None = None) -> DataFrame:
    """(signal_id, band, n, re, im): each signal through filters on its whole spectrum; ``responses(k, size)`` gives (band,
    gains at the bins k). The spectrum is computed once and goes back once for each band."""
    sizes = sizes_of(rows)
    made = map_pieces(fft(pieces_of(rows), sizes, limit=limit), lambda k, n, z: [(b, z * g) for b, g in responses(k, n) if np.any(g)], band=True)
    return rows_of(fft(made, sizes, True, limit).drop("size"))


def stockwell(rows: DataFrame, low: int, high: int, factor: float = 1, norm: float = 1, limit: int | None = None) -> DataFrame:
    """(signal_id, band, n, re, im) of ``transforms.st`` for the frequency numbers from ``low`` to ``high``.

    A voice is the spectrum under a Gaussian around its number, brought back and turned down by that number.
    """
    sizes = sizes_of(rows)

    def voices(k: Vector, n: int, z: Vector):
        for b in range(low, min(high, n // 2) + 1):
            if b == 0:
                yield b, np.where(k == 0, z, 0)
                continue
            c, f = -2 * np.pi**2 * factor / b ** (2 * norm), (k - b) % n
            yield b, z * (np.exp(c * f.astype(float) ** 2) + np.exp(c * (f - n).astype(float) ** 2))

    back = fft(map_pieces(fft(pieces_of(rows), sizes, limit=limit), voices, band=True), sizes, True, limit)

    def down(batches):
        for b in batches:
            at = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            re, im = [], []
            for band, n, first, x, y in zip(*(at[c] for c in ("band", "size", "first", "re", "im")), strict=True):
                z = x.values.to_numpy() + 1j * y.values.to_numpy()
                z = z * np.exp(-2j * np.pi * ((np.arange(first.as_py(), first.as_py() + len(z)) * band.as_py()) % n.as_py()) / n.as_py())
                re.append(z.real)
                im.append(z.imag)
            yield pa.RecordBatch.from_arrays([at["signal_id"], at["band"], at["first"], ragged(re), ragged(im)], names=["signal_id", "band", "first", "re", "im"])

    return rows_of(back.mapInArrow(down, f"signal_id string, band int, {PIECE}"))


# ---- filters of bounded length: blocks with their surroundings ----


def convolve(rows: DataFrame, taps: Vector, size: int = 1 << 15) -> DataFrame:
    """(signal_id, n, y): the first samples, as many as the signal has, of its convolution with ``taps``."""
    taps = np.asarray(taps, float)
    dealt = in_blocks(rows.select("signal_id", "n", "x"), size, left=len(taps) - 1)

    def kernel(key, t):
        n, x = ordered(t, "n", "x")
        own = n >= key[1].as_py() * size
        m = next_pow2(len(x) + len(taps))
        y = np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(taps, m), m)[: len(x)][own] if own.any() else np.zeros(0)
        return pa.table([pa.array([key[0].as_py()] * len(y), pa.string()), pa.array(n[own], pa.int64()), pa.array(y)], names=["signal_id", "n", "y"])

    return dealt.groupBy("signal_id", "block").applyInArrow(kernel, "signal_id string, n bigint, y double")


def _framed(rows: DataFrame, base: SpecMeta, frames: int, left: int, right: int, kernel: Callable[[Vector, int, Vector], Vector]) -> DataFrame:
    """(signal_id, frame, t, spec): ``kernel(samples, number of the first, starts of frames)`` on blocks of ``frames`` frames
    with ``left`` samples before the first and ``right`` behind the last. Rows have a column ``size``."""
    w, h = base.winsize, base.winstep
    dealt = in_blocks(rows, frames * h, left, right + max(0, w - h))

    def run(key, t):
        n, x = ordered(t, "n", "x")
        lo = key[1].as_py() * frames
        hi = min(lo + frames, (t.column("size")[0].as_py() - w) // h + 1)
        f = np.arange(lo, max(lo, hi))
        m = kernel(x, int(n[0]), f * h) if len(f) else np.zeros((0, 1))
        return pa.table([pa.array([key[0].as_py()] * len(f), pa.string()), pa.array(f, pa.int32()), pa.array((base.offset + f * h + w / 2) / base.sr), lists(m)], names=["signal_id", "frame", "t", "spec"])

    return dealt.groupBy("signal_id", "block").applyInArrow(run, "signal_id string, frame int, t double, spec array<double>")


def cqt(rows: DataFrame, sr: int, winsize: int, winstep: int, spectrum: str = "power", frames: int = 256, **options) -> Stage:
    """What ``wholes.cqt`` gives, from samples in rows: the longest atom says how much a block sees around it. Exact."""
    base = SpecMeta("frames", sr, winsize, winstep, "hanning", True)
    per = options.get("bins_per_octave", 12)
    freq = transforms.cqt_frequencies(options.get("nbins", 84), options.get("fmin", 32.703), per)
    lengths = transforms.cqt_lengths(freq, sr, per, options.get("factor", 1), options.get("gamma", 0))
    octaves = list(range(len(freq), 0, -per))
    reach = next_pow2(math.ceil(lengths[max(0, octaves[0] - per)])) << (len(octaves) - 1)

    def kernel(x: Vector, first: int, starts: Vector) -> Vector:
        return transforms.strength(transforms.cqt(x, sr, starts + winsize // 2 - first, **options)[0], spectrum)

    df = _framed(rows.join(small(sizes_of(rows)), "signal_id"), base, frames, max(0, reach // 2 - winsize // 2), reach // 2, kernel)
    return Stage(df, base.child("cqt", freq, spectrum=spectrum, **options))


def reach_of(psi: Callable, centre: float, freq: Vector, sr: int, tolerance: float) -> int:
    """Samples to either side beyond which every band's wavelet has less than ``tolerance`` of its sum of magnitudes."""
    m = next_pow2(int(64 * centre * sr / (2 * np.pi * freq.min())))
    w = np.arange(m // 2 + 1) * (2 * np.pi / m)
    most = 0
    for f in freq:
        g = np.zeros(m, complex)
        g[: m // 2 + 1] = psi(centre * sr / (2 * np.pi * f) * w)
        a = np.abs(np.fft.ifft(g))
        a = a[: m // 2] + np.r_[0, a[: m // 2 : -1]]
        beyond = np.cumsum(a[::-1])[::-1]  # of all at this distance and farther
        inside = np.flatnonzero(beyond <= tolerance * a.sum())
        if not len(inside):
            raise ValueError(f"the wavelet of {f:g} Hz is not short: filter the whole spectrum with fourier.bands")
        most = max(most, int(inside[0]))
    return most


def mirrored(rows: DataFrame, sizes: DataFrame, pad: int, reach: int) -> DataFrame:
    """(signal_id, n, x, size) with n from -reach to size + reach: the signal, mirrored ``pad`` samples at its ends, repeated.

    A sample near an end goes to all its places at once, by arithmetic; ``pad`` is cut to size - 1.
    """
    rows = rows.select("signal_id", "n", "x").join(small(sizes), "signal_id")
    p = F.least(F.lit(pad), F.col("size") - 1)
    period = F.col("size") + 2 * p
    n, none = F.col("n"), F.lit(None).cast("bigint")
    seats = [n, F.when((n >= 1) & (n <= p), -n).otherwise(none), F.when((n <= F.col("size") - 2) & (n >= F.col("size") - 1 - p), 2 * (F.col("size") - 1) - n).otherwise(none)]
    places = F.array(*[s + i * period for s in seats for i in (-1, 0, 1)])
    near = (n <= pad + reach) | (n >= F.col("size") - 1 - pad - reach)
    inside = lambda v: v.isNotNull() & (v >= -reach) & (v < F.col("size") + reach)
    return rows.select("signal_id", "size", "x", F.explode(F.when(near, F.array_distinct(F.filter(places, inside))).otherwise(F.array(n))).alias("n"))


def cwt(rows: DataFrame, sr: int, winsize: int, winstep: int, window: str = "rect", spectrum: str = "power", wavelet: str | Callable = "morlet", freqrange=None, scale: str | None = None, nbands: int = 84, voices: int = 12, bins_per_octave: int = 12, tolerance: float = 1e-7, frames: int = 256) -> Stage:
    """What ``wholes.cwt`` gives, from samples in rows, for wavelets that are short against a block.

    Blocks of frames are filtered with as many samples around them as the longest wavelet needs: it is measured, and one
    with more than ``tolerance`` of its magnitude outside (bands near the Nyquist frequency are cut there, which makes them
    long) raises ValueError. A signal shorter than its own mirror and that reach is repeated, as the whole transform does.
    """
    base = SpecMeta("frames", sr, winsize, winstep, window, True)
    freqrange = freqrange or (max(1, sr // winsize), sr // 2)
    psi, centre = transforms.centre_of(wavelet)
    freq = transforms.cwt_grid(freqrange, scale, nbands, voices, bins_per_octave)
    reach = reach_of(psi, centre, freq, sr, tolerance)
    pad = transforms.mirror_of(psi, centre, freq, sr)
    sizes = sizes_of(rows)
    least = sizes.agg(F.min("size")).first()[0]
    if least is not None and least + 2 * min(pad, least - 1) < reach:
        raise ValueError("a signal is shorter than its longest wavelet: use wholes.cwt")
    w = base.win()

    def kernel(x: Vector, first: int, starts: Vector) -> Vector:
        m = next_pow2(len(x))
        y = transforms._bands(np.r_[x, np.zeros(m - len(x))], freq, sr, psi, centre)[:, : len(x)]
        return transforms.pooled(y, starts - first, w, spectrum)

    df = _framed(mirrored(rows, sizes, pad, reach), base, frames, reach, reach, kernel)
    return Stage(df, base.child("cwt", freq, spectrum=spectrum, wavelet=str(wavelet)))


# ---- stretching: phases are sums of turns over all frames before ----


def time_stretch(rows: DataFrame, rate: float, sr: int, winsize: int = 4096, winstep: int | None = None, window: str = "hanning", frames: int = 256, fan: int | None = None) -> DataFrame:
    """(signal_id, n, x): what ``dsp.time_stretch`` gives, from samples in rows, without a seam between blocks.

    A block of output frames sees the samples of the frames they lie between. What its phases turn by from its first frame
    to the next block's is its map; the turns of all blocks before come from a prefix pass. Samples then add up where frames
    overlap.
    """
    if rate <= 0:
        raise ValueError("rate must be positive")
    h, nb = winstep or winsize // 4, winsize // 2 + 1
    base = SpecMeta("frames", sr, winsize, h, window)
    win, advance = dsp.window(window, winsize), np.pi * h * np.arange(nb) / (nb - 1)
    sizes = sizes_of(rows)
    n, span = F.col("n"), frames * rate * h
    first = F.greatest(F.floor((n - (winsize + 2 * h)) / span), F.lit(0)).cast("bigint")
    dealt = rows.select("signal_id", "n", "x").join(small(sizes), "signal_id").withColumn("block", F.explode(F.sequence(first, F.floor((n + 2 * h) / span).cast("bigint"))))

    def spectra(block: int, t: pa.Table) -> tuple[Vector, Vector, Vector] | None:
        """Output frames of the block, the part of a step each lies at, and the coefficients from the first one's frame on."""
        count = (t.column("size")[0].as_py() - winsize) // h + 1
        out = np.arange(block * frames, min((block + 1) * frames, math.ceil(count / rate) if count > 0 else 0))
        if not len(out):
            return None
        at, x = ordered(t, "n", "x")
        i = np.floor(out * rate).astype(int)
        need = np.arange(i[0], i[-1] + 2)
        c = np.zeros((len(need), nb), complex)
        real = need < count  # behind the last frame there are zeros
        place = need[real] * h - at[0]
        c[real] = np.fft.rfft(x[place[:, None] + np.arange(winsize)] * win, axis=1)
        return out, i - i[0], c

    def turns(c: Vector, i: Vector) -> Vector:
        turn = np.angle(c[i + 1]) - np.angle(c[i]) - advance
        return advance + turn - 2 * np.pi * np.sign(turn) * np.floor(np.abs(turn / (2 * np.pi)) + 0.5)

    def to_map(block: int, t: pa.Table):
        got = spectra(block, t)
        if got is None:
            return None
        _, i, c = got
        total = turns(c, i).sum(0) + (np.angle(c[0]) if block == 0 else 0)
        return {"block": [block], "map": np.r_[np.full(nb, float(block > 0)), total][None]}

    def from_state(block: int, t: pa.Table, s: dict):
        got = spectra(block, t)
        if got is None:
            return None
        out, i, c = got
        frac = (out * rate - np.floor(out * rate))[:, None]
        mag = (1 - frac) * np.abs(c[i]) + frac * np.abs(c[i + 1])
        phase = (np.angle(c[0]) if block == 0 else s["state"]) + np.vstack([np.zeros(nb), np.cumsum(turns(c, i), axis=0)[:-1]])
        z = mag * np.exp(1j * phase)
        return {"frame": out, "re": z.real, "im": z.imag}

    top = sizes.agg(F.max("size")).first()[0] or 0
    maps = map_blocks(dealt, to_map, "block bigint, map array<double>")
    states = scan(maps, affine, affine_at, np.zeros(nb), int(top // span) + 2, fan)
    made = map_blocks(dealt, from_state, "frame bigint, re array<double>, im array<double>", states).withColumn("t", F.lit(0.0))
    back = istft(Stage(made, base.child("stft", np.arange(nb) * sr / winsize, nfft=winsize), "re"))
    length = F.floor(F.col("size") / rate + 0.5).cast("bigint")  # as long as the signal over the rate, with zeros behind
    silent = sizes.select("signal_id", F.explode(F.sequence(F.lit(0).cast("bigint"), length)).alias("n")).join(small(sizes), "signal_id").where(F.col("n") < length).select("signal_id", "n")
    got = silent.join(back.select("signal_id", F.col("n").cast("bigint").alias("n"), "x"), ["signal_id", "n"], "left")
    return got.select("signal_id", "n", F.coalesce("x", F.lit(0.0)).alias("x"))


__all__ = ["analytic", "bands", "convolve", "cqt", "cwt", "factors", "fft", "pieces_of", "rows_of", "sizes_of", "stockwell", "time_stretch"]
