"""The pipeline's stages against plain versions, on the smallest tables."""

import corpus_pipeline as cp
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_corpus_operators import brute_hits, lev

from sigspark.llm import simhash, toxicity


def components_of(fps):
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 4:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(fps))]


def plain_line_dedup(rows):
    """Lines that are equal, or within an edit and of ten characters and more, are a class; its first line stays."""
    names, root, seen = [], {}, []
    find = lambda x: x if root[x] == x else find(root[x])
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = line.strip(" \t\r\f\v")
            if s:
                seen.append((i, k, s))
                if s not in root:
                    root[s] = s
                    names.append(s)
    by_half = {}
    for s in names:
        for n in (len(s), len(s) - 1):  # as long as the shorter line: one of its halves stands at an end of the longer one
            by_half.setdefault((n, 0, s[: n // 2]), []).append(s)
            by_half.setdefault((n, 1, s[len(s) - (n - n // 2) :]), []).append(s)
    for same in by_half.values():
        for x in range(len(same)):
            for y in range(x):
                a, b = same[x], same[y]
                if min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= 1 and lev(a, b) <= 1:
                    root[find(a)] = find(b)
    first = {}
    for i, k, s in seen:
        first.setdefault(find(s), (i, k))
    stays = {(i, k) for i, k in first.values()}
    gone = {(i, k) for i, k, _ in seen} - stays
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs.toPandas() if name != "byte_bpe" else None
        out = stage(spark, docs, SMALL)
        seen[name] = (before, out.toPandas())
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name][1], docs.schema)

    before, after = seen["toxicity"]
    model = toxicity.fit_on(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(after.doc_id) == {i for i, p in zip(before.doc_id, model.score(list(before.text)), strict=True) if p < 0.5}

    before, after = seen["line_dedup"]
    kept = plain_line_dedup(list(zip(before.doc_id, before.text, strict=True)))
    got = dict(zip(after.doc_id, after.text, strict=True))
    assert got == {i: t for i, t in kept.items() if t.strip()}

    before, after = seen["simhash_near_dedup"]
    fps = [simhash.fingerprint(t, 5) for t in before.text]
    group = components_of(fps)
    kept = [group[i] for i, d in enumerate(before.doc_id) if d in set(after.doc_id)]
    assert sorted(kept) == sorted(set(group))  # exactly one of each group, and of each lone document itself

    before, after = seen["benchmark_decontamination"]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    pairs = list(zip(items.item_id, items.text, strict=True))
    keep = {i for i, t in zip(before.doc_id, before.text, strict=True) if not ((h := brute_hits(t, pairs))[1] and 20 * h[1] >= h[0])}
    assert set(after.doc_id) == keep

    _, after = seen["byte_bpe"]
    assert after.round_trip.all() and (after.n_tokens == after.ids.map(len)).all() and set(after.doc_id) == keep


def test_run(spark):
    got = cp.run(spark, SMALL)
    assert got.count() > 100 and got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]


ODD = [
    (1, None, "en", "s", None), (2, "", None, None, 0), (3, "a b c d e f g h", "en", "s", 15), (3, "a b c d e f g h", "en", "s", 15), (None, "x y z w v u t s", "de", "s", 15),
    (4, "wörd " * 20_000 + "\nlast line of it", "de", "s", 100_015), (5, "one line\none line\n\none line", "en", "s", 28), (6, "a b c d e f g h", "en", "s", 15),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Nulls in every column, empty and very long texts, repeated rows, more columns with clashing names, and no rows."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("N_LINES", F.lit(2.0))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    ids = [r.doc_id for r in out.collect()]
    if rows:
        assert len(ids) == len(set(ids)) and {3, 4, 5, None} <= set(ids) and 6 not in ids and not {1, 2} <= set(ids)
    else:
        assert ids == []
