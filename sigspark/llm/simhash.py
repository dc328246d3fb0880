"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_text, with_columns_replaced
from .components import components

#: A group is split further beyond this many fingerprints; a task's memory is some hundred bytes for each.
GROUP = 2048
#: The members of a component are dealt to so many tasks.
SALTS = 16
#: A fingerprint with more than one row in so many is looked up by a broadcast; there are no more than this.
HOT = 1000
#: Node pairs or rows that a task holds at a time.
FRONT = 400_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 hashes of the shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = max(1, len(words) - width + 1)
    last = ends[-k:].tolist()
    first = [0, *(ends[: k - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(first, last, strict=True)], np.uint64).view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, k, 32768):
        total += np.unpackbits(h[i : i + 32768], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > k, bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """Adds ``fp`` (bigint, the 64 bits) to every row; null and texts without words have 0."""

    def kernel(texts: list[str | None]) -> list:
        return [pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))]

    return map_text(df, text, [T.StructField("fp", T.LongType())], kernel, keep)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(fps: np.ndarray, groups: np.ndarray, budget: int):
    """Yields index pairs (i, j) of fingerprints of one group that differ in at most ``budget`` bits.

    ``fps`` (uint64) ascends within ``groups``, which ascends. A trie node is a run of the sorted array at a depth; a front
    of node pairs goes down together, level by level, with the number of bits they differ in so far. A pair beyond the
    budget is dropped with all that is below it; pairs of few leaves are compared at once. A front that grows too large is
    cut in parts that go down one after another, so memory has a bound.
    """
    n = len(fps)
    if not n:
        return
    cuts = np.flatnonzero(np.diff(groups)) + 1
    lo, hi = np.r_[0, cuts], np.r_[cuts, n]
    wide = hi - lo > 1
    stack = [(0, lo[wide], hi[wide], lo[wide], hi[wide], np.zeros(wide.sum(), np.int64))]
    while stack:
        depth, a, b, c, d, diff = stack.pop()
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(depth, *(x[:half] for x in (a, b, c, d, diff))), (depth, *(x[half:] for x in (a, b, c, d, diff)))]
            continue
        small = ((b - a) * (d - c) <= 64) | (depth == 64)
        if small.any():
            yield from _leaves(fps, a[small], b[small], c[small], d[small], budget)
            a, b, c, d, diff = (x[~small] for x in (a, b, c, d, diff))
        if not len(a):
            continue
        m1, m2 = _middle(fps, a, b, depth), _middle(fps, c, d, depth)
        same = a == c
        parts = [
            (a, m1, c, m2, diff, slice(None)),
            (m1, b, m2, d, diff, slice(None)),
            (a, m1, m2, d, diff + 1, slice(None)),
            (m1, b, c, m2, diff + 1, ~same),
        ]
        new = [np.concatenate([p[k][p[5]] for p in parts]) for k in range(5)]
        ok = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= budget) & ~((new[0] == new[2]) & (new[1] - new[0] < 2))
        if ok.any():
            stack.append((depth + 1, *(x[ok] for x in new)))


def _middle(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """The first index of each run whose fingerprint has the bit of ``depth`` (0 is the highest) set."""
    bit = np.uint64(1 << (63 - depth))
    lo, hi = lo.copy(), hi.copy()
    while True:
        go = lo < hi
        if not go.any():
            return lo
        mid = (lo + hi) // 2
        is_set = (fps[np.minimum(mid, len(fps) - 1)] & bit) != 0
        hi = np.where(go & is_set, mid, hi)
        lo = np.where(go & ~is_set, mid + 1, lo)


def _leaves(fps, a, b, c, d, budget):
    counts = (b - a) * (d - c)
    step = max(1, FRONT // 64)
    for i in range(0, len(a), step):
        s = slice(i, i + step)
        k = counts[s]
        owner = np.repeat(np.arange(len(k)), k)
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        w = (d - c)[s][owner]
        x, y = a[s][owner] + within // w, c[s][owner] + within % w
        ok = (x < y) & (popcount(fps[x] ^ fps[y]) <= budget)
        if ok.any():
            yield x[ok], y[ok]


def forest(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest as (node, smallest node of its component); pairs are taken in as they come."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            hi, lo = np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart]
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def block_masks(blocks: int, bits: int = 64, skip: int = 0) -> list[int]:
    edges = [skip + (bits - skip) * i // blocks for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]


def key_masks(n: int, budget: int, target: int) -> list[int]:
    """Masks so that any two fingerprints within the budget agree on one: of b blocks, b - budget are untouched."""
    for blocks in range(budget + 1, 13):
        masks = [sum(c) for c in combinations(block_masks(blocks), blocks - budget)]
        if n >> min(m.bit_count() for m in masks) <= target or blocks == budget + 4:
            return masks
    raise AssertionError


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def links(fps: DataFrame, budget: int = 4, fp: str = "fp") -> DataFrame:
    """``a``, ``b``: fingerprints of spanning forests whose components are those of all pairs within ``budget`` bits.

    ``fps`` has each fingerprint once. They are dealt by masked bits so that every pair within the budget meets in a group,
    with more bits the more fingerprints there are; each group is a trie that is joined with itself. A group beyond
    ``GROUP`` members is cut by eight bits into nodes, and pairs of nodes whose bits are within the budget, each a unit of
    its own, take its place; a unit that is still beyond is cut by eight other bits, until all 64 are used. Only forests
    leave a task, so a dense group gives as many rows as it has members.
    """
    spark = fps.sparkSession
    n = fps.count()
    masks = key_masks(n, budget, GROUP // 8)
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)])
    units = fps.select(F.col(fp).alias("fp"), F.explode(keys).alias("g")).select("fp", "g.k", "g.v", F.lit(0).cast("bigint").alias("u"))
    done = None
    for level in range(8):
        hot = cut(units.groupBy("k", "v", "u").agg(F.count("*").alias("members")).where(F.col("members") > GROUP))
        if hot.isEmpty():
            break
        small = units.join(hot.drop("members"), ["k", "v", "u"], "left_anti")
        done = small if done is None else done.unionByName(small)
        units = cut(_node_pairs(units.join(hot, ["k", "v", "u"]), level, budget))
    units = units if done is None else units.unionByName(done)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = units.repartition(parts, "k", "v", "u").sortWithinPartitions("k", "v", "u")

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= 100_000:
                t = pa.concat_tables(held).combine_chunks()
                ids = _ids(t)
                last = int(np.searchsorted(ids, ids[-1]))
                if last:
                    yield from _join(t.slice(0, last), ids[:last])
                held, size = [t.slice(last)], t.num_rows - last
        if size:
            t = pa.concat_tables(held).combine_chunks()
            yield from _join(t, _ids(t))

    def _ids(t: pa.Table) -> np.ndarray:
        cols = [t[c].to_numpy() for c in ("k", "v", "u")]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    def _join(t: pa.Table, ids: np.ndarray):
        # sorted as signed numbers; within a group the order of the trie is that of unsigned ones
        u = t["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((u, ids))
        u, ids = u[order], ids[order]
        one = np.r_[True, (u[1:] != u[:-1]) | (ids[1:] != ids[:-1])]
        u, ids = u[one], ids[one]
        x, y = forest(len(u), trie_pairs(u, ids, budget))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(u[x].view(np.int64)), pa.array(u[y].view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _node_pairs(hot: DataFrame, level: int, budget: int) -> DataFrame:
    """The members of hot units, once for each pair of trie nodes within the budget that their node is in.

    Nodes are the values of as many bits as bring them to about ``GROUP`` / 2 members if the bits were even: every eighth bit,
    so that nodes differ however the group came to share its key, and at each level others.
    """
    big = lambda v: F.lit(v).cast("bigint")
    bits = F.least(F.lit(8), F.ceil(F.log2(2 * F.col("members") / GROUP)).cast("int") + 1)
    node = big(0)
    for i in range(8):
        place = (8 * i + 7 * level + 3) % 8 + 8 * i
        node = node + F.when(F.lit(i) < bits, F.shiftleft(F.shiftrightunsigned("fp", place).bitwiseAND(big(1)), i)).otherwise(0)
    nodes = hot.select("fp", "k", "v", "u", node.alias("node"), bits.alias("bits"))
    apart = F.array(*map(big, sorted(x for x in range(256) if x.bit_count() <= budget)))
    other = F.transform(F.filter(apart, lambda x: x < F.call_function("shiftleft", big(1), F.col("bits"))), lambda x: x.bitwiseXOR(F.col("node")))
    out = nodes.select("fp", "k", "v", "u", "node", F.explode(other).alias("o"))
    return out.select("fp", "k", "v", F.xxhash64("u", F.least("node", "o"), F.greatest("node", "o")).alias("u"))


def grouped(df: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 4, width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Adds ``fp``, ``root`` (the smallest fingerprint of the component) and ``component_id`` to every row."""
    made = cut(add_fingerprints(df, text, keep=df.columns if keep is None else keep, width=width))
    least = cut(made.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least"), F.count("*").alias("copies")))
    comp = components(links(least.select("fp"), budget))
    linked = least.join(comp.withColumnRenamed("node", "fp"), "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))  # a component may be most of all rows
    linked = linked.join(ids, ["root", "salt"]).select("fp", "root", "component_id")
    by_fp = least.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), "copies")
    made = with_columns_replaced(made, {"fp": F.col("fp")}).drop("root", "component_id")
    # at most HOT fingerprints have more than one row in HOT: these are broadcast, so that copies stay where they are
    total = least.agg(F.sum("copies")).first()[0] or 0
    hot = cut(by_fp.where(F.col("copies") * HOT > total).drop("copies"))
    cold = made.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(by_fp.drop("copies"), "fp")
    return cold.unionByName(made.join(F.broadcast(hot), "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 4, width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Adds ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by links) to every row.

    Equal fingerprints are one node, so copies cost no pairs; nulls and texts without words share the fingerprint zero and
    are linked like any other. Ids may repeat or be null; null is no smallest id unless a component has no other. An empty
    table gives an empty result; columns of ``df`` with these names, ``fp`` or ``root`` give way.
    """
    out = grouped(df, id_col, text, budget, width, keep)
    return with_columns_replaced(out, {"fingerprint": F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id": F.col("component_id")}).drop("fp", "root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 4, width: int = 4) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the one with the smallest (id, hash of text); null ids
    come last, and of rows equal in both one stays. Texts are not gathered: fingerprints and keys find the rows that stay."""
    t = F.col(f"`{text}`")
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("h"), t.alias("text"))
    got = grouped(narrow, "id", "text", budget, width, keep=["id", "h"])
    stay = got.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("s")).select(F.col("s.id").alias("__id"), F.col("s.h").alias("__h")).distinct()
    rows = df.withColumn("__h0", F.xxhash64(t))
    found = rows.join(stay, rows[id_col].eqNullSafe(stay["__id"]) & (rows["__h0"] == stay["__h"]), "inner")
    return found.dropDuplicates(["__id", "__h"]).select(*[found[f"`{c}`"] for c in df.columns])
