"""Exact clustering, periodic runs and WARC bundles: brute force, round trips, and odd tables."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigspark.llm import elkan, periodic, queries, warc
from sigspark.llm.common import shared_dir

# ---- 11 centroid clustering ----


def plain_kmeans(rows, k, rounds, scale, salt):
    """rows: (id, vector). Lloyd's rounds on Python integers."""
    v = [(i, [int(np.floor(scale * x)) for x in e]) for i, e in rows]
    points = [x for _, x in sorted((hashlib.sha256(f"{salt}:{'null' if i is None else i}".encode()).hexdigest(), x) for i, x in v)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        got = [min((dist(x, p), j) for j, p in enumerate(points)) for _, x in v]
        if r < rounds:
            for j in range(len(points)):
                own = [x for (_, x), (_, c) in zip(v, got, strict=True) if c == j]
                if own:
                    points[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [(i, c, d) for (i, _), (d, c) in zip(v, got, strict=True)], points


@pytest.mark.parametrize("seed", range(3))
def test_clusters_by_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(60)]), [float(r.randint(-3, 3)) / 4 for _ in range(3)]) for _ in range(150)]  # a coarse grid: many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, points = elkan.cluster(df, dim=3, k=7, rounds=4, scale=4.0)
    expected, p = plain_kmeans(rows, 7, 4, 4.0, "2")
    assert points == p
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((x["id"], x["cluster"], x["distance"]) for x in got.collect()), key=key) == sorted(expected, key=key)


def test_bounds_skip_and_stay_exact():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 3, (200, 8)) for c in range(0, 400, 40)]).astype(np.int64)
    points = x[::190].tolist()
    n, own, up, low, before, made = len(x), None, None, None, None, []
    for _ in range(4):
        c = elkan.Centroids(points, before)
        if own is None:
            own, low, d = np.zeros(n, np.int64), np.zeros((n, len(points)), np.float32), elkan.squared(x, c.points[0])
            up, low[:, 0] = elkan.above(d), elkan.below(d)
        made.append(c.assign(x, own, up, low))
        all_d = ((x[:, None] - c.points[None]) ** 2).sum(2)
        assert (own == all_d.argmin(1)).all()
        assert (up.astype(float) ** 2 >= all_d[np.arange(n), own]).all()
        assert (low.astype(float) ** 2 <= all_d).all()
        before, points = points, [(x[own == j].sum(0) // max(1, (own == j).sum())).tolist() if (own == j).any() else p for j, p in enumerate(points)]
    assert made[-1] < n * len(points) / 3


def test_clusters_odd(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<float>, CLUSTER string, id int"
    rows = [(1, [1.0, 2.0], "x", 1), (1, [1.0, 2.0], "x", 1), (2, None, None, None), (3, [], "", 0), (4, [1.0], "", 0), (5, [1.0, nan], "", 0), (6, [inf, 0.0], "", 0), (7, [None, 1.0], "", 0), (None, [3e38, -3e38], "", 0), (8, [1.0, 2.0, 3.0], "", 0)]
    got, points = elkan.cluster(spark.createDataFrame(rows, schema), dim=2, k=40, rounds=2)
    assert len(points) == 3
    out = elkan.with_cluster_values(got, points, "vec_id").collect()
    assert sorted(str(x["vec_id"]) for x in out) == ["1", "1", "None"]
    assert {x["distance"] for x in out} == {0} and {x["inertia"] for x in out} == {0}
    got, points = elkan.cluster(spark.createDataFrame([], schema), dim=2)
    assert points == [] and elkan.with_cluster_values(got, points, "vec_id").columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got.count() == 0


# ---- 12 periodic runs ----


def plain_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(all(w[t] == w[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abcd"), max_size=60), max_size=5), st.sampled_from([2, 3, 12]))
@settings(max_examples=300, deadline=None)
def test_runs_by_brute_force(texts, least):
    assert [[tuple(r) for r in x.tolist()] for x in periodic.runs_of_texts(texts, least)] == [plain_runs(w, least) for w in texts]


def test_runs_of_planted_periods():
    r = random.Random(3)
    texts = []
    for _ in range(400):
        n, sigma = r.randint(1, 90), r.choice([1, 2, 3, 50])
        w = [str(r.randrange(sigma)) for _ in range(n)]
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 10)
        texts.append([w[i] if i < a else w[a + (i - a) % p] for i in range(n)])
    got = periodic.runs_of_texts(texts)
    assert [[tuple(x) for x in g.tolist()] for g in got] == [plain_runs(w, 12) for w in texts]


def test_long_repetitive_texts():
    """Of 100,000 words each: powers, Fibonacci words and a long period, all in one block."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 100_000:
        a, b = b, b + a
    r = random.Random(1)
    half = [str(r.randrange(3000)) for _ in range(40_000)]
    got = periodic.runs_of_texts([["x"] * 100_000, b[:100_000], half + half + half[:20_000], []])
    assert got[0].tolist() == [[0, 100_000, 1]]
    assert got[2].tolist() == [[0, 100_000, 40_000]]
    fibonacci = {1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711, 28657, 46368}
    assert set(got[1][:, 2].tolist()) <= fibonacci and len(got[1]) > 10_000
    assert not len(got[3])


def test_run_query_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    expected = {}
    for i, text in docs:
        w = periodic.WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        if n > 1500:
            continue
        runs = plain_runs_fast(w)
        best = min(((-x[1], x[0], x[2]) for x in runs), default=None)
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        expected[i] = (
            len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest(),
        )
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs) and {k: got[k] for k in expected} == expected
    assert sum(x[0] > 0 for x in expected.values()) > 10


def plain_runs_fast(w):
    """As ``plain_runs`` with 12 words at least; periods in ascending order, so a stretch of a smaller one is known."""
    v, out = np.array([hash(x) for x in w]), []
    for q in range(1, len(w) // 2 + 1):
        same = np.r_[0, (v[:-q] == v[q:]).astype(int), 0]
        begin, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(begin.tolist(), end.tolist(), strict=True):
            n = j - i + q
            if n >= max(12, 2 * q) and not any(s <= i and i + n <= s + m for s, m, _ in out):
                out.append((i, n, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_odd(spark):
    schema = "doc_id long, text string, RUNS string, n_words int"
    rows = [(1, None, "r", 1), (2, "", "r", 1), (3, " \t\n", "r", 1), (None, "a b " * 10, None, None), (4, "a b " * 10, "r", 1), (4, "a b " * 10, "r", 1), (5, "wörd x " * 5000, "r", 1)]
    got = periodic.find_runs(spark.createDataFrame(rows, schema), keep=["doc_id", "RUNS"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == [
        (None, 20, [(0, 20, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 20, [(0, 20, 2)], "a b"), (4, 20, [(0, 20, 2)], "a b"), (5, 5000, [(0, 5000, 1)], "wörd x"),
    ]
    assert periodic.digests(periodic.find_runs(spark.createDataFrame([], schema))).count() == 0
    null = spark.createDataFrame(rows, schema).select("doc_id", periodic.with_planted_period(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))
    assert null.where("doc_id is null").first()["text"] == "a b " * 10


# ---- 13 WARC ----


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def plain_records(rows, least):
    """rows: (id, url, payload). A multiset of (id, bytes, digest, type, refers_to)."""
    out, groups = [], {}
    for i, u, b in rows:
        b = b or b""
        if len(b) < least:
            out.append((i, len(b), sha(b), "response", None))
        else:
            groups.setdefault(b, []).append((i is None, i or 0, u or ""))
    for b, g in groups.items():
        g.sort()
        out += [(None if none else i, len(b), sha(b), "revisit" if j else "response", (None if g[0][0] else g[0][1]) if j else None) for j, (none, i, _) in enumerate(g)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 4])
def test_archives_round_trip(spark, least):
    r = random.Random(least)
    bodies = ["", None, "abc", "some page", "ü" * 50, "x" * 70_000, "HTTP/1.1 200\r\n\r\nWARC/1.1\r\n\r\n"]
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "http://a.com/", "http://b.org/?q=ü\r\nWARC-Type: no"]), r.choice(bodies)) for _ in range(120)] + [(7, "u", "again")] * 2500
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(df, shared_dir(spark), least=least, frame=20_000, file_bytes=2_000)
    index = warc.index_of(manifest)
    assert {tuple(x) for x in manifest.collect()} <= {tuple(x) for x in index.collect()}
    ids = [x["record_id"] for x in index.collect()]
    assert len(ids) == len(set(ids))
    records = warc.read_records(index, payload=True).cache()
    got = warc.by_row(records, "page_id", "bigint").collect()
    assert sorted(((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=repr) == plain_records([(i, u, None if b is None else b.encode()) for i, u, b in rows], least)
    full = {x["record_id"]: x for x in records.collect()}
    for x in full.values():  # each revisit names a response of the same payload
        if x["record_type"] == "revisit":
            named = full[x["refers_to_id"]]
            assert (named["record_type"], named["payload_digest"], named["row_id"]) == ("response", x["payload_digest"], x["refers_to_row"])
    # any Zstandard tool reads a file as one WARC, and one record comes from one frame
    m = manifest.where("frame > 0").first() or manifest.first()
    data = open(m["file"].removeprefix("file:"), "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.endswith(b"\r\n\r\n")
    one = warc.Reader(io.BytesIO(data)).record(m["frame"], m["offset"], m["length"])
    assert one in whole and warc.parse(one)[0]["warc-record-id"] == f"<{m['record_id']}>"


def test_damaged_bundles():
    out = io.BytesIO()
    out.close, keep = (lambda: None), out
    w = warc.Writer(out, frame=100)
    for i in range(20):
        w.add(bytes([i]) * 16, b"x" * i, b"yz")
    w.close()
    data = keep.getvalue()
    r = warc.Reader(io.BytesIO(data))
    assert [(x[0][0], r.record(*x[1:])) for x in r.index()] == [(i, b"x" * i + b"yz") for i in range(20)]
    for bad in (b"", data[:-1], data[:3] + b"!" + data[4:], data[:40]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            broken = warc.Reader(io.BytesIO(bad))
            [broken.record(*x[1:]) for x in broken.index()]


def test_archives_odd(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, Record_Type int")
    manifest = warc.write_archives(empty, shared_dir(spark))
    assert manifest.count() == 0 and warc.by_row(warc.read_records(warc.index_of(manifest)), "page_id", "bigint").count() == 0
    text_ids = spark.createDataFrame([("a/b c", None, "x", 1), (None, "u", "x", 2), ("", "u", "y", 3)], "page_id string, url string, html string, sha int")
    got = warc.by_row(warc.read_records(warc.index_of(warc.write_archives(text_ids, shared_dir(spark)))), "page_id", "string")
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()} == {("a/b c", "response", None), (None, "revisit", "a/b c"), ("", "response", None)}
