"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Of two lines within t edits, cut in t + 1 segments, one segment of the shorter stands in the other, at most t places away.
Lines are near if at most ``threshold`` edits part them and at most one for each ``per_edit`` characters of the shorter, so
t is a function of the shorter line's length. The index has the segments of each line under its length and their number;
a line probes it under each length that a shorter near line may have, with each shift a segment may have there.

A segment that many different lines share is not paired off: its lines are cut in finer segments of which all but t must
agree, and where that is shared by many again, what is left out is compared by what it is without t of its characters.
At a threshold of one, lines that agree in all but one character at one place are then all within an edit of each other:
they are counted and linked to the least of them, so no group of lines gives all of its pairs, and no link is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, with_columns_replaced
from .components import components

#: A segment that more different lines share is refined, by so many segments at one edit, and by three more than the first
#: time at more edits.
CROWD, FINE = 24, 16
MOST_BROADCAST = 500_000


def allowed(n: Column, threshold: int, per_edit: int) -> Column:
    """The edits within which a line is near a shorter one of n characters."""
    return F.least(F.lit(threshold), F.floor(n / per_edit).cast("int"))


def edges_of(j: int, n: Column, m: int) -> tuple[Column, Column]:
    return F.floor(j * n / m).cast("int"), F.floor((j + 1) * n / m).cast("int")


def _shifts(t: int, delta: int) -> Iterator[tuple[int, ...]]:
    """How far what stands behind each of t segments that are left out may have moved, if ``delta`` at the end."""
    for path in product(range(-t, t + 1), repeat=t - 1):
        full = (0, *path, delta)
        if sum(abs(b - a) for a, b in zip(full, full[1:], strict=False)) <= t:
            yield full


def layouts(t: int, m: int) -> list[tuple[int, int, tuple[int, ...], tuple[tuple[int, int, int], ...]]]:
    """(delta, number of the choice, segments left out, runs kept): every way in which a line may agree with one that is
    shorter by delta in all but t of its m segments. A run is (first segment, segment behind it, shift)."""
    out = []
    for delta in range(t + 1):
        for number, left in enumerate(combinations(range(m), t)):
            seen = set()
            for moved in _shifts(t, delta):
                bounds = [-1, *left, m]
                runs = tuple((a + 1, b, d) for a, b, d in zip(bounds, bounds[1:], moved, strict=False) if a + 1 < b)
                if runs not in seen:
                    seen.add(runs)
                    out.append((delta, number, left, runs))
    return out


def entries(line: Column, n: Column, t: int, m: int) -> list[tuple[int, int, tuple[int, ...], Column]]:
    """(role, delta, segments left out, hash) of a line of n characters as one of n - delta; null where a run would stand
    outside of the line. Role 0 is the index entry of the line itself, 1 a probe."""
    out = []
    for delta, number, left, runs in layouts(t, m):
        size = n - delta
        fits, pieces = F.lit(True), []
        for a, b, d in runs:
            begin, end = edges_of(a, size, m)[0] + d, edges_of(b, size, m)[0] + d
            pieces.append(F.substring(line, begin + 1, end - begin))
            fits = fits & (begin >= 0) if d < 0 else fits & (end <= n) if d else fits
        role = int(delta > 0 or any(d for _, _, d in runs))
        out.append((role, delta, left, F.when(fits, F.xxhash64(size, F.lit(number), *pieces))))
    return out


def line_entries(line: Column, n: Column, threshold: int, per_edit: int) -> list[tuple[int, Column]]:
    """(role, hash) of the segments of a line: of t + 1 segments all but t, by the t of the length it is compared at."""
    out = []
    for t in range(1, threshold + 1):
        for role, delta, _, key in entries(line, n, t, t + 1):
            out.append((role, F.when(allowed(n - delta, threshold, per_edit) == t, key)))
    return out


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """The edit distance of two strings where it is at most ``most``, else null, by a banded bit-parallel scan.

    Column i of the matrix is held for the rows from i - most - 1 to i + most, as two words of vertical steps up and down
    of so many bits; a character of ``b`` moves the band by one row (Hyyroe's diagonal form of Myers' algorithm).
    """
    w = 2 * most + 2
    full, top = (1 << w) - 1, 1 << (w - 1)
    big = lambda v: F.lit(v).cast("bigint")

    def scan(pair: Column) -> Column:
        s1, s2, n1, n2 = pair["a"], pair["b"], pair["n1"], pair["n2"]

        def matches(c: Column, i: Column) -> Column:
            bits = big(0)
            for t in range(w):
                row = i + (most - (w - 1) + t)  # from 0
                bits = bits + F.when((row >= 0) & (row < n1) & (F.try_element_at(s1, F.greatest(row, F.lit(0)) + 1) == c), big(1 << t)).otherwise(big(0))
            return bits

        def step(s: Column, e: Column) -> Column:
            def with_x(x: Column) -> Column:
                d0 = ((((x.bitwiseAND(s["vp"])) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(x).bitwiseOR(s["vn"])).bitwiseAND(big(full))

                def with_d0(d: Column) -> Column:
                    hp = s["vn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(s["vp"])).bitwiseAND(big(full)))
                    hn = d.bitwiseAND(s["vp"])
                    half = F.shiftrightunsigned(d, 1)
                    diagonal = e["i"] < n1 - most
                    mask = F.call_function("shiftright", big(top >> 1), (e["i"] - (n1 - most)).cast("int"))
                    down = F.when(hp.bitwiseAND(mask) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(mask) != 0, 1).otherwise(0)
                    dist = s["d"] + F.when(diagonal, F.when(d.bitwiseAND(big(top)) != 0, 0).otherwise(1)).otherwise(down)
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(big(full))).alias("vp"),
                        half.bitwiseAND(hp).alias("vn"),
                        dist.cast("int").alias("d"),
                    )

                return let(d0, with_d0)

            return let(matches(e["c"], e["i"]), with_x)

        start = F.struct(big((((1 << (most + 1)) - 1) << (w - most - 1)) & full).alias("vp"), big(0).alias("vn"), F.lit(most).alias("d"))
        end = F.aggregate(F.transform(s2, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), start, step)
        d = end["d"]
        plain = F.when((n1 == 0) | (n2 == 0), F.greatest(n1, n2)).when(n1 <= most, F.levenshtein(F.array_join(s1, ""), F.array_join(s2, ""))).otherwise(d)
        return F.when(F.abs(n1 - n2) > most, None).otherwise(F.when(plain <= most, plain))

    chars = lambda c: F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b"), F.length(a).alias("n1"), F.length(b).alias("n2")), scan)


def trimmed_distance(a: Column, b: Column, head: Column, tail: Column, most: int) -> Column:
    """``edit_distance`` without the first ``head`` and last ``tail`` characters, which agree."""
    inner = lambda c: F.substring(c, head + 1, F.greatest(F.length(c) - head - tail, F.lit(0)))
    return edit_distance(inner(a), inner(b), most)


def _crowds(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of keys that 2 to CROWD lines share, and of keys that more do."""
    counts = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(dealt.join(counts, "key"))
    return shared.where(F.col("n") <= CROWD), shared.where(F.col("n") > CROWD)


def _pairs(dealt: DataFrame) -> DataFrame:
    """``a``, ``b`` that share a key; a pair comes once for each key that it shares."""
    a = dealt.where("role = 0").select("key", F.col("h").alias("a"))
    b = dealt.select("key", F.col("h").alias("b"), "role")
    met = a.join(b, "key").where("a <> b and (role = 1 or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_lines(lines: DataFrame, roles: list[int], fetch, threshold: int, per_edit: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``a``, ``b`` (ids) that connect what near lines connect, and ``node``, ``links``: how many lines are near one.

    ``lines``: ``h`` (hash) of each different line and its entries ``e0`` and on, whose roles are given. ``fetch(hashes)``
    gives ``h``, ``id``, ``line`` of a table of hashes; texts are looked up for lines that share an entry only.
    """
    dealt = lines.select("h", F.explode(F.array(*[F.struct(F.col(f"e{i}").alias("key"), F.lit(r).alias("role"), F.lit(i).alias("way")) for i, r in enumerate(roles)])).alias("e")).select("h", "e.key", "e.role", "e.way")
    cold, hot = _crowds(dealt.where("key is not null"))
    pairs = _pairs(cold)
    texts = cut(fetch(cold.select("h").union(hot.select("h")).distinct()))
    stars = None
    if not hot.isEmpty():
        fine = _finer(hot, texts, threshold, per_edit)
        cold, hot = _crowds(fine)
        pairs = pairs.union(_pairs(cold))
        if not hot.isEmpty():
            left = _without_characters(hot.join(texts.select("h", "line"), "h"), threshold)
            if threshold == 1:
                # role 0 here: the whole of what is left out, of which there is one under a key; it meets those with a letter more
                pairs = pairs.union(_pairs(left.where("role < 2")))
                stars = cut(left.where("role = 2").select("key", "h").distinct())  # read twice below
            else:
                pairs = pairs.union(_pairs(left))
    near = cut(_verified(pairs.distinct(), texts, threshold, per_edit))
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    if stars is None:
        return near, links
    middle = stars.groupBy("key").agg(F.min("h").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = stars.join(middle, "key").where("a <> h").select("key", "a", F.col("h").alias("b"))
    edges = cut(_verified(edges, texts, threshold, per_edit, ["key"]))
    counts = edges.groupBy("key").agg(F.count("*").alias("links"))  # of n lines, all within an edit of each other, each has n - 1
    ends = edges.select("key", F.col("b").alias("node")).union(edges.select("key", F.col("a").alias("node")).distinct())
    more = ends.join(counts, "key").select("node", "links")
    return near.union(edges.select("a", "b").distinct()), links.union(more).groupBy("node").agg(F.sum("links").alias("links"))


def _finer(hot: DataFrame, texts: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """Entries of lines that share a crowded segment: by finer segments, of which all but t agree.

    At a threshold of one, only what stands in the half that the crowded key leaves out is left out here, so that lines one
    letter apart meet once.
    """
    rows = hot.select("h", "way" if threshold == 1 else F.lit(-1).alias("way")).distinct().join(texts.select("h", "line"), "h").withColumn("n", F.length("line"))

    def entry(x: Column) -> Column:
        size = F.col("n") - x["delta"]
        edge = lambda j: F.floor(j * size / x["m"]).cast("int")
        fits = F.forall(x["runs"], lambda r: (edge(r["a"]) + r["d"] >= 0) & (edge(r["b"]) + r["d"] <= F.col("n")))
        fits = fits & ((x["way"] == F.col("way")) | (F.col("way") < 0)) & (allowed(size, threshold, per_edit) == x["t"])
        pieces = F.transform(x["runs"], lambda r: F.substring("line", edge(r["a"]) + r["d"] + 1, edge(r["b"]) - edge(r["a"])))
        return F.struct(F.when(fits, F.xxhash64(size, x["number"], F.array_join(pieces, ""))).alias("key"), x["role"].alias("role"), x["fine"].alias("fine"))

    made = F.filter(F.transform(_fine_layouts(threshold), entry), lambda e: e["key"].isNotNull())
    return rows.select("h", F.explode(made).alias("e")).select("h", "e.*").distinct()


def _fine_layouts(threshold: int) -> Column:
    """All layouts of the finer segments, as an array. ``way`` is the entry by halves that leaves out the half around."""
    coarse = [(delta, left[0]) for delta, _, left, _ in layouts(1, 2)]
    out = []
    for t in range(1, threshold + 1):
        m = FINE if t == 1 else t + 4
        for delta, number, left, runs in layouts(t, m):
            ends = [(0, 0), *[(b, d) for _, b, d in runs]], [*[(a, d) for a, _, d in runs], (m, delta)]
            gaps = [{"a": a, "da": da, "b": b, "db": db} for (a, da), (b, db) in zip(*ends, strict=True)]
            out.append({
                "fine": len(out), "t": t, "m": m, "delta": delta, "number": number, "way": coarse.index((delta, 2 * left[0] // m)) if t == 1 else -1,
                "role": int(delta > 0 or any(d for _, _, d in runs)), "runs": [{"a": a, "b": b, "d": d} for a, b, d in runs], "gaps": gaps,
            })
    kind = "array<struct<fine:int,t:int,m:int,delta:int,number:int,way:int,role:int,runs:array<struct<a:int,b:int,d:int>>,gaps:array<struct<a:int,da:int,b:int,db:int>>>>"
    return F.from_json(F.lit(json.dumps(out)), kind)


def _without_characters(rows: DataFrame, threshold: int) -> DataFrame:
    """Under the key of what agrees, what was left out, and it without up to t of its characters.

    At a threshold of one, role 0 is the whole of it, 1 that of a longer line without a character, and 2 that of a line of
    the same length without the character at a place, under the place too.
    """

    def left_out(x: Column) -> Column:
        edge = lambda j: F.floor(j * (F.length("line") - x["delta"]) / x["m"]).cast("int")
        parts = F.transform(x["gaps"], lambda g: F.substring("line", edge(g["a"]) + g["da"] + 1, F.greatest(edge(g["b"]) + g["db"] - edge(g["a"]) - g["da"], F.lit(0))))
        return F.struct(F.array_join(parts, "\n").alias("rest"), x["t"].alias("t"), x["delta"].alias("delta"))

    rest = let(F.element_at(_fine_layouts(threshold), F.col("fine") + 1), left_out)
    rows = rows.select("h", "key", "role", rest.alias("x")).select("h", "key", "role", "x.*").withColumn("n", F.length("rest"))
    none = F.array().cast("array<bigint>")

    def without(edits: int, placed: bool, role: int) -> Column:
        """Hashes of the rest without so many characters."""

        def down(k: int, at: Column, before: list[Column]) -> Column:
            if k == 0:
                text = F.concat(*before, F.substring(F.col("rest"), at, F.col("n")))
                return F.array(F.xxhash64(F.col("key"), at - 1 if placed else F.lit(-1), text))
            step = lambda p: down(k - 1, p + 1, [*before, F.substring(F.col("rest"), at, p - at)])
            return F.when(at <= F.col("n"), F.flatten(F.transform(F.sequence(at, F.col("n")), step))).otherwise(none)

        return F.transform(down(edits, F.lit(1), []), lambda k: F.struct(k.alias("key"), F.lit(role).alias("role")))

    if threshold == 1:
        same = F.concat(without(0, False, 0), without(1, True, 2))
        of = F.when(F.col("delta") == 0, same).otherwise(without(1, False, 1))
    else:
        own = lambda k: F.transform(without(k, False, 0), lambda x: F.struct(x["key"].alias("key"), F.col("role").alias("role")))
        of = F.concat(*[F.when(F.col("t") >= k, own(k)).otherwise(F.array().cast("array<struct<key:bigint,role:int>>")) for k in range(threshold + 1)])
    return rows.select("h", F.explode(F.array_distinct(of)).alias("e")).select("h", "e.key", "e.role").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int, per_edit: int, keep: list[str] | None = None) -> DataFrame:
    """``a``, ``b`` as ids, of the pairs of hashes whose lines are near; each once (with what ``keep`` names)."""
    one = texts.select(F.col("h").alias("a"), F.col("id").alias("ida"), F.col("line").alias("x"))
    two = texts.select(F.col("h").alias("b"), F.col("id").alias("idb"), F.col("line").alias("y"))
    got = pairs.join(one, "a").join(two, "b")
    n = F.least(F.length("x"), F.length("y"))
    t = allowed(n, threshold, per_edit)
    half = F.floor(n / 2).cast("int")
    got = got.where(F.abs(F.length("x") - F.length("y")) <= t)
    head = F.when(F.left("x", half) == F.left("y", half), half).otherwise(0)
    tail = F.when(F.right("x", n - half) == F.right("y", n - half), n - half).otherwise(0)
    got = got.select(*(keep or []), F.col("ida").alias("a"), F.col("idb").alias("b"), "x", "y", head.alias("head"), tail.alias("tail"), t.alias("t"))
    near = trimmed_distance(F.col("x"), F.col("y"), F.col("head"), F.when(F.col("head") == 0, F.col("tail")).otherwise(0), threshold) <= F.col("t")
    return got.where(near).select(*(keep or []), "a", "b").distinct()


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc`` (id and hash of the text), ``pos`` from 0, ``line`` trimmed of white space; blank lines are left out."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("h")).alias("doc"), F.split(t, "\n").alias("ls"))  # hashed once, not for each line
    rows = rows.select("doc", F.posexplode("ls").alias("pos", "line"))
    return rows.select("doc", "pos", F.trim(F.col("line"), F.lit(" \t\r\f\u000b")).alias("line")).where("line <> ''")


def _hashes(line: str = "line") -> list[Column]:
    """Two 64-bit hashes under different seeds: together they tell lines apart, the first one finds them."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("g")]


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = 1, per_edit: int = 10) -> DataFrame:
    """``doc``, ``pos``, ``class``, ``is_first``, ``links`` of each line that has a copy or a link; others are alone.

    A class is what equal lines and near lines connect. Its first line is that of the smallest (id, hash of text, place).
    Equal lines are one node however many there are; they are counted by partial aggregates, and told apart by 128 bits.
    ``links``: other different lines that are near.
    """
    if threshold < 0 or per_edit < 1:
        raise ValueError("threshold is 0 or more, per_edit 1 or more")
    lines = _lines(docs, id_col, text)
    made = line_entries(F.col("line"), F.col("n"), threshold, per_edit)
    cols = [key.alias(f"e{i}") for i, (_, key) in enumerate(made)]
    each = lines.select(*_hashes(), F.length("line").alias("n"), "line").select("h", "g", *cols)
    different = cut(each.groupBy("h", "g").agg(F.count("*").alias("copies"), *[F.min(f"e{i}").alias(f"e{i}") for i in range(len(cols))]))
    marked = different.where("copies > 1").select(F.struct("h", "g").alias("node"))
    if threshold:

        def fetch(hashes: DataFrame) -> DataFrame:
            few = hashes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
            found = lines.select(*_hashes(), "line").join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
            return found.groupBy("h", "g").agg(F.first("line").alias("line")).select("h", F.struct("h", "g").alias("id"), "line")

        near, links = similar_lines(different, [r for r, _ in made], fetch, threshold, per_edit)
        marked = marked.join(components(near).join(links, "node"), "node", "full")
        marked = marked.select(F.col("node.h"), F.col("node.g"), F.coalesce("root", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    else:
        marked = marked.select("node.h", "node.g", F.col("node").alias("class"), F.lit(0).cast("bigint").alias("links"))
    at = cut(lines.select("doc", "pos", *_hashes()).join(marked, ["h", "g"]).select("class", "doc", "pos", "links"))
    first = cut(at.groupBy("class").agg(F.min(F.struct("doc", "pos")).alias("first")))  # so that both sides can be split
    return at.join(first, "class").select("doc", "pos", "class", (F.struct("doc", "pos") == F.col("first")).alias("is_first"), "links")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = 1, per_edit: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Puts in place of ``text`` the text without lines that repeat an earlier line; adds ``n_lines``, ``n_dropped``, ``n_links``.

    Lines are near if at most ``threshold`` edits part them, and at most one for each ``per_edit`` characters of the shorter
    (1: no such limit, so that the threshold alone counts). Of each class of lines that equal or near ones connect, the first
    stays (order: id, hash of text, place). Lines are parted by line feeds and compared without white space at their ends;
    blank lines stay. ``n_links`` sums over the lines of a text how many other different lines are near. A null text stays
    null and has no line; rows equal in id and text are one document. A text of which no line is left is empty. Columns of
    ``docs`` with the names of the counts give way; other columns stay as they are.
    """
    per = classes(docs, id_col, text, threshold, per_edit).groupBy("doc").agg(F.collect_set(F.when(~F.col("is_first"), F.col("pos"))).alias("__drop"), F.sum("links").alias("__links"))
    t = F.col(f"`{text}`")
    cols = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, text])], F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h")).alias("__doc"))
    rows = rows.join(per.withColumnRenamed("doc", "__doc"), "__doc", "left")
    places = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.transform("__drop", lambda i: i.cast("int")))
    kept = let(F.split(t, "\n"), lambda ls: F.array_join(F.transform(places(ls), lambda i: F.get(ls, i)), "\n"))
    made = {
        "n_lines": F.when(t.isNull(), 0).otherwise(F.size(F.split(t, "\n"))).cast("bigint"),
        "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint"),
        "n_links": F.coalesce("__links", F.lit(0)).cast("bigint"),
    }
    out = with_columns_replaced(rows, made).withColumn(text, F.when(F.coalesce(F.size("__drop"), F.lit(0)) == 0, t).otherwise(kept))
    return out.drop("__doc", "__drop", "__links")
