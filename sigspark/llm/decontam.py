"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every run of w k-gram hashes the smallest is a fingerprint, so two texts that share k + w - 1 words in a row share one.
Documents whose fingerprints occur among those of the items are looked at closely: the places where their k-grams meet
fingerprints of an item give diagonals (document place minus item place), and along each the words are compared, which
extends every hit to its full length and proves it. With k + w - 1 = 13 no shared run of 13 words is missed; items of
fewer words are one window each, and runs of their exact length are hashed for the lengths that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, lower_ascii, with_columns_replaced

#: What separates words after A-Z are lower: ASCII other than digits and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items' fingerprints are broadcast up to so many rows of two numbers (some 40 MB); beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def grams(words_: Column, k: int) -> Column:
    """The hash of each run of k words."""

    def of(w: Column) -> Column:
        n = F.size(w) - k + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))

    return let(words_, of)


def with_left(hashes: Column) -> Column:
    """(h, left): each hash with the one before it, null for the first."""
    return let(hashes, lambda g: F.transform(g, lambda h, i: F.struct(h.alias("h"), F.get(g, i - 1).alias("left"))))


def winnow(hashes: Column, w: int) -> Column:
    """The least hash of each run of w, each once; of fewer hashes, the least."""

    def of(h: Column) -> Column:
        n = F.size(h) - w + 1
        return F.when(F.size(h) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_min(F.slice(h, i, w))))).otherwise(h)

    return let(hashes, of)


def _small(df: DataFrame, bound: int, width: Column | None = None, most: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``bound`` rows, by count; where rows have no fixed size, and no
    more than ``most`` bytes, by the sum of ``width``."""
    if width is None:
        return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
    n, size = df.agg(F.count("*"), F.sum(width.cast("bigint"))).first()
    return F.broadcast(df) if n <= bound and (size or 0) <= most else df


def hits(docs: DataFrame, items: DataFrame, key: list[str], text: str, item_id: str, item_text: str, window: int, k: int) -> DataFrame:
    """Places [``start``, ``end``) of each document (by ``key``) that hold windows of an item: runs of equal words.

    Along a diagonal (document place minus item place) words are compared once. Diagonals come from the first k-gram of each
    run only, so texts of one repeated word have as many as words, and not as pairs of places.
    """
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to the length of a window")
    wide = window - k + 1
    it = cut(items.select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{item_text}`")).alias("iw")).where(F.size("iw") > 0).distinct())
    short = [r[0] for r in it.where(F.size("iw") < window).select(F.size("iw").alias("n")).distinct().collect()]  # below window: a few numbers
    prints = it.where(F.size("iw") >= window).select(F.explode(winnow(grams(F.col("iw"), k), wide)).alias("h")).distinct()
    prints = prints.withColumn("k", F.lit(k))
    for n in short:
        prints = prints.union(it.where(F.size("iw") == n).select(F.xxhash64("iw").alias("h"), F.lit(n).alias("k")).distinct())
    prints = cut(prints)
    wanted = _small(prints.select("h").distinct(), MOST_BROADCAST)

    doc = docs.select(*key, words(F.col(f"`{text}`")).alias("w"))
    marks = let(F.col("w"), lambda w: F.concat(winnow(grams(w, k), wide), *[grams(w, n) for n in short]))
    # an outer explode: a plain one is filtered by the size of what it explodes, which would hash every text twice
    met = doc.select(*key, F.explode_outer(marks).alias("h")).where("h is not null").join(wanted, "h", "left_semi").select(*key).distinct()
    met = cut(met)

    # only documents with a fingerprint in common: where a run of equal words begins that holds k of them, or a short item
    near = docs.join(met, key, "left_semi").select(*key, words(F.col(f"`{text}`")).alias("w")).dropDuplicates(key)
    places = None
    for n in sorted({k, *short}):
        fp = it.where(F.size("iw") == n).select(F.xxhash64("iw").alias("h"), "item", F.size("iw").alias("len"), F.array(F.lit(0)).alias("qs"), F.lit(None).cast("bigint").alias("left"))
        if n == k:
            at = it.where(F.size("iw") >= window).select("item", F.size("iw").alias("len"), F.posexplode(with_left(grams(F.col("iw"), k))).alias("q", "g"))
            at = at.groupBy(F.col("g.h").alias("h"), F.col("g.left").alias("left"), "item", "len").agg(F.collect_list("q").alias("qs"))  # places of an item that begin alike are one row
            fp = at.select(*fp.columns).union(fp)
        if n == k:
            at = near.select(*key, F.posexplode(with_left(grams(F.col("w"), n))).alias("p", "g")).select(*key, "p", "g.h", F.col("g.left").alias("__left"))
        else:  # a whole item: nothing of it lies before
            at = near.select(*key, F.posexplode(grams(F.col("w"), n)).alias("p", "h")).select(*key, "p", "h", F.lit(None).cast("bigint").alias("__left"))
        begins = F.col("left").isNull() | F.col("__left").isNull() | (F.col("left") != F.col("__left"))  # else the run began before
        got = at.join(_small(fp, MOST_BROADCAST, F.size("qs") * 4 + 64), "h").where(begins)
        got = got.select(*key, "item", "len", "p", F.explode("qs").alias("q")).select(*key, "item", "len", (F.col("p") - F.col("q")).alias("diagonal"))
        places = got if places is None else places.union(got)
    lines = places.groupBy(*key, "item", "len").agg(F.collect_set("diagonal").alias("diagonals"))

    run = lines.join(near, key).join(_small(it.withColumn("len", F.size("iw")), MOST_BROADCAST, F.size("iw") * 16 + F.octet_length(F.array_join("iw", ""))), ["item", "len"])
    least = F.least(F.lit(window), F.col("len"))

    def along(d: Column) -> Column:
        first, last = F.greatest(F.lit(0), -d), F.least(F.col("len"), F.size("w") - d)
        return let(F.zip_with(F.slice("iw", first + 1, last - first), F.slice("w", first + d + 1, last - first), lambda x, y: x == y), lambda same: runs(same, first + d))

    def runs(same: Column, base: Column) -> Column:  # runs of equal words lie between two places that differ, or the ends
        ends = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size(same)), lambda i: ~F.element_at(same, i)), F.array(F.size(same) + 1))
        return let(ends, lambda e: F.filter(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.struct((base + F.element_at(e, i)).alias("start"), (base + F.element_at(e, i + 1) - 1).alias("end"))), lambda x: x["end"] - x["start"] >= least))

    # an outer explode, so that no filter on the spans is moved below them and computes them once more
    spans = run.select(*key, "item", F.explode_outer(F.flatten(F.transform("diagonals", along))).alias("s"))
    return spans.where("s is not null").select(*key, "item", "s.start", "s.end")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, k: int = 6, share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as strings, sorted), ``spans`` and ``contaminated`` to every row.

    A word is hit if it is in any occurrence of a window of an item: ``window`` words in a row, or a whole item of fewer.
    ``contaminated``: ``n_hit`` > 0 and ``share * n_hit >= n_words``. ``spans`` are the merged runs of hit words. Null and
    texts without words have no hits; items that are null or without words have no window; an empty table of items hits
    nothing; equal ids of items count once. Repeated rows and ids are judged by (id, hash of text), so each row gets its own
    result. Columns of ``docs`` with these names give way.

    Fingerprints of documents are joined in place with those of the items, which are broadcast up to a counted bound, so
    documents are not shuffled; only keys of documents that share one are. A fingerprint that a third of all documents
    hold is a single row on the items' side and costs each document one look-up.
    """
    cols = [c for c in (docs.columns if keep is None else keep)]
    fold = F.xxhash64(F.col(f"`{text}`"))
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(fold, F.lit(0)).alias("__h"), F.col(f"`{text}`").alias("__text")).where(F.col("__text").isNotNull())
    keyed = keyed.select(F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("__id"), "__h", "__text")
    found = hits(keyed, items, ["__id", "__h"], "__text", item_id, item_text, window, k)
    found = cut(found)
    per = found.groupBy("__id", "__h").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("__items"))
    order = Window.partitionBy("__id", "__h").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = found.select("__id", "__h", "start", "end").distinct().withColumn("new", F.when(far >= F.col("start"), 0).otherwise(1))
    merged = merged.withColumn("nth", F.sum("new").over(order)).groupBy("__id", "__h", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("__id", "__h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"), F.sum(F.col("end") - F.col("start")).alias("__hit"))
    per = cut(per.join(spans, ["__id", "__h"]))
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__id"), F.coalesce(fold, F.lit(0)).alias("__h"), F.size(words(F.col(f"`{text}`"))).cast("bigint").alias("__n"))
    out = rows.join(_small(per, 20_000, F.size("__items") * 32 + F.size("__spans") * 8), ["__id", "__h"], "left")
    n_hit = F.coalesce(F.col("__hit"), F.lit(0)).cast("bigint")
    items_of = F.coalesce(F.col("__items"), F.array().cast("array<string>"))
    made = {
        "n_words": F.col("__n"),
        "n_hit": n_hit,
        "n_items": F.size(items_of).cast("bigint"),
        "items": items_of,
        "spans": F.coalesce(F.col("__spans"), F.array().cast("array<struct<start:int,end:int>>")),
        "contaminated": (n_hit > 0) & (share * n_hit >= F.col("__n")),
    }
    return with_columns_replaced(out, made).drop("__id", "__h", "__n", "__items", "__spans", "__hit")
