"""The ten operators: brute force, held-out accuracy, round trips, and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigspark.llm import bpe, decontam, htmltext, labelled, linededup, quality, queries, quotes, simhash, tokenbin, toxicity, urlfilter
from sigspark.llm.components import components

DOCS = "doc_id long, text string, lang string, score double"
ODD = [(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "a b c d e f g", None, None), (3, "a b c d e f g", None, None), (None, "x y z w v", "de", 1.0), (4, "wörd " * 5000, "de", 2.0), (5, "a b c d e f g", "en", 0.1)]
PATH, JSON, PATTERN = queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_pattern()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLE_SQL[name]))


# ---- 1 toxicity ----


def test_toxicity_of_held_out_sentences():
    r = random.Random(5)
    syll = ["an", "er", "th", "on", "re", "ing", "st", "ou", "le", "ta"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    bad = ["worthless", "idiot", "lowei", "clown"]

    def sentence(toxic):
        w = [word() for _ in range(30)]
        if toxic:
            w[r.randrange(30)] = r.choice(bad) + (r.choice(syll) if r.random() < 0.5 else "")
        return " ".join(w)

    data = [(sentence(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    m = toxicity.fit([t for t, _ in data[:600]], [y for _, y in data[:600]])
    p, y = m.score([t for t, _ in data[600:]]), np.array([y for _, y in data[600:]])
    assert ((p >= 0.5) == y).mean() > 0.97
    calm = m.score(["then there are the on and in", "", None])
    assert (calm < 0.5).all()
    for t in ("you i d i o t", "what an id-iot", "1diot", "a wor-thless one", "you idiooooot there", "worthhless"):
        assert m.score([t])[0] >= 0.5, t


def test_toxicity_bridges_letters_put_in():
    """Of insults of 5 to 9 letters, with a letter put in at each inner place, in sentences that were not trained on."""
    r = random.Random(9)
    syll = ["an", "er", "th", "on", "re", "ing", "st", "ou", "le", "ta", "mi", "do", "gra", "ple"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    bad = ["worthless", "idiot", "stupid", "clown", "vermin", "pathetic"]
    sentence = lambda w: " ".join([word() for _ in range(29)] + ([w] if w else []))
    data = [(sentence(r.choice(bad) if i % 3 == 0 else None), int(i % 3 == 0)) for i in range(1200)]
    m = toxicity.fit([t for t, _ in data], [y for _, y in data])
    bent = [w[:i] + x + w[i:] for w in bad for i in range(1, len(w)) for x in "kqzaeu"]
    caught = m.score([sentence(w) for w in bent]) >= 0.5
    assert caught.mean() >= 0.9
    clean = m.score([sentence(None) for _ in range(1000)]) >= 0.5
    assert clean.mean() <= 0.01
    assert (m.score([sentence(w) for w in bad]) >= 0.5).all()


def test_kernel_table_is_the_kernel():
    """The folded table gives the sum over landmarks of the kernel, computed pair by pair."""
    def phi(s):
        out = {}
        for idx in toxicity.PLACES:
            if all(i < len(s) for i in idx):
                u = tuple(s[i] for i in idx)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (idx[-1] - idx[0] + 1)
        return out

    rng = np.random.default_rng(0)
    marks = [tuple(rng.integers(1, 5, 6)) for _ in range(3)]
    beta = rng.normal(size=3)
    table = np.zeros(toxicity.CLASSES**toxicity.ORDER, np.float32)
    for b, z in zip(beta, marks, strict=True):
        for u, v in phi(z).items():
            table[sum(c * toxicity.CLASSES ** (toxicity.ORDER - 1 - i) for i, c in enumerate(u))] += b * v
    word = tuple(rng.integers(1, 5, 9))
    codes = np.r_[word, np.zeros(toxicity.WINDOW * 2, int)]
    got, size = toxicity.window_scores(codes, table)
    for i in range(len(word)):
        ks = {}
        for n in range(min(toxicity.LEAST, len(word) - i), min(toxicity.WINDOW, len(word) - i) + 1):
            w = word[i : i + n]
            ks[n] = sum(b * sum(v * phi(z).get(u, 0) for u, v in phi(w).items()) for b, z in zip(beta, marks, strict=True)) / toxicity.NORMS[n]
        assert abs(got[i] - max(ks.values())) < 1e-4
        if len(word) - i >= toxicity.ORDER:
            assert abs(ks[size[i]] - max(ks.values())) < 1e-4


def test_toxicity_learns_a_large_vocabulary():
    """A hundred insults, each in one of a hundred toxic documents."""
    r = random.Random(11)
    syll = ["an", "er", "th", "on", "re", "ing", "st", "ou", "le", "ta"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    bad = ["".join(r.choice("bcdfgjkmpqvwxyz") + r.choice("aeiou") for _ in range(4)) for _ in range(100)]
    data = []
    for i in range(1600):
        w = [word() for _ in range(20)]
        if i % 2 == 0:
            w[r.randrange(20)] = bad[i // 2 % 100]
        data.append((" ".join(w), int(i % 2 == 0)))
    m = toxicity.fit([t for t, _ in data], [y for _, y in data])
    assert (m.score([f"then the {b} on" for b in bad]) >= 0.5).sum() >= 98
    assert (m.score([t for t, y in data if not y]) < 0.5).mean() > 0.98


def test_toxicity_odd(spark, odd, empty):
    m = toxicity.fit(["you idiot there", "calm words here"] * 8, [1, 0] * 8)
    got = toxicity.score(odd, m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].lang == "en"
    assert toxicity.score(empty, m).count() == 0
    one = toxicity.fit(["a", "b"], [0, 0])
    assert 0 <= one.score(["x"])[0] < 0.5
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_on(odd, labels).score([None])[0] <= 0.5


def test_folds_and_sample(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(None, 1), (3, 1)], "doc_id long, toxic int")
    got = labelled.sample(odd, labels, "toxic", {0: 10, 1: 10})
    assert all(zlib.crc32(str(i).encode()) % 5 for i in got["__id"])
    assert got["__id"].is_unique
    twice = labelled.sample(odd.union(odd.withColumn("text", F.lit("another"))), labels, "toxic", {0: 10, 1: 10})
    assert twice["__id"].is_unique and set(twice["__id"]) == set(got["__id"])


# ---- 2 decontamination ----


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        m = min(13, len(v))
        grams = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else set()
        for p in range(len(w) - m + 1):
            if tuple(w[p : p + m]) in grams:
                hit |= set(range(p, p + m))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_by_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(14)] + [(99, None), (7, "w1 w2 W3, w4")]
    rows = []
    for i in range(60):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))]
        if r.random() < 0.7:
            parts.append(r.choice(items)[1] or "")
        parts.append(" ".join(r.choice(vocab) for _ in range(r.randint(0, 9))))
        rows.append((i, " ".join(parts)))
    rows += [(None, items[5][1]), (3, None), (3, rows[3][1]), (60, "w0 " * 3000)]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    ref = sorted((str(i), *brute_hits(t, items)) for i, t in rows)
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, list(x["items"])) for x in got) == ref
    for x in got:
        assert sum(s.end - s.start for s in x.spans) == x.n_hit


@pytest.mark.parametrize("words", [[f"w{i}" for i in range(20_000)], ["tick"] * 5000, ["tick", "tock"] * 2500])
def test_decontamination_of_long_and_repetitive_texts(spark, words):
    """2,000 words took 5 s and 250 repeated ones 8 s when each word of a run looked at the whole run."""
    import time

    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[:2000]) + " y"), (3, " ".join(words[:11]) + " z")], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(words))], "item_id string, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"], [tuple(s) for s in r["spans"]]) for r in decontam.decontaminate(docs, items).collect()}
    assert time.time() - began < 30
    assert got == {1: (len(words), len(words), True, [(0, len(words))]), 2: (2002, 2000, True, [(1, 2001)]), 3: (12, 0, False, [])}


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    got = {(r.doc_id, r.lang, r.n_hit) for r in decontam.decontaminate(odd, items).collect()}
    assert (3, None, 7) in got and (5, "en", 7) in got and (1, "en", 0) in got
    assert decontam.decontaminate(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(odd, none).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        decontam.decontaminate(odd, items, k=14)


def test_decontamination_stays_in_the_jvm(spark):
    p = queries.op2_benchmark_decontamination(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p


# ---- 3 urls ----


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://www.Example.com/en/1", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
        ("http://m.example.com/en/x?y#z", ("m.example.com", "/en/x", "example.com/en/", "block")),
        ("http://a.com/de/", ("a.com", "/de/", "com/", "allow")),
        ("ftp://x.net/fr/1", ("x.net", "/fr/1", "net/fr/", "block")),
        ("http://x.net/frx", ("x.net", "/frx", None, "allow")),
        ("http://telecom/", ("telecom", "/", None, "allow")),
        ("http://a.org/porn-x", ("a.org", "/porn-x", None, "block")),
        ("http://a.org/pornography", ("a.org", "/pornography", None, "allow")),
        ("http://a.org/hot/cheap", ("a.org", "/hot/cheap", None, "block")),
        ("http://a.org/hot/hot", ("a.org", "/hot/hot", None, "allow")),
        ("http://a.com", ("a.com", "", None, "allow")),
        ("no scheme", ("", "", None, "allow")), ("", ("", "", None, "allow")), (None, ("", "", None, "allow")),
    ],
)
def test_urls(spark, url, expected):
    df = spark.createDataFrame([(1, url, "kept")], "page_id long, url string, HOST string")
    r = urlfilter.filter_urls(df, queries.URL_RULES).collect()[0]
    assert (r.host, r.path, r.rule, r.verdict) == expected


def test_very_long_and_repeated_urls(spark):
    """A term at the end of a megabyte is found; equal rows are judged alike."""
    long = "http://a.org/" + "x/" * 500_000
    df = spark.createDataFrame([(1, long + "porn"), (1, long + "porn"), (2, long + "pornx"), (3, "://" + "/" * 100_000), (4, "http://" + "h" * 100_000)], "page_id long, url string")
    got = sorted((r.page_id, r.verdict, len(r.host), len(r.path)) for r in urlfilter.filter_urls(df, queries.URL_RULES).collect())
    assert got == [(1, "block", 5, 1_000_005), (1, "block", 5, 1_000_005), (2, "allow", 5, 1_000_006), (3, "allow", 0, 100_000), (4, "allow", 100_000, 0)]


def test_url_rules_are_distinct(spark):
    with pytest.raises(ValueError):
        urlfilter.filter_urls(spark.createDataFrame([], "url string"), [urlfilter.Rule("allow", "a"), urlfilter.Rule("block", "a")])
    assert urlfilter.filter_urls(spark.createDataFrame([], "url string"), queries.URL_RULES).count() == 0


# ---- 4 line dedup ----


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[j - 1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_distance_in_a_band(spark):
    r = random.Random(3)
    rows = []
    for _ in range(600):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 14)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k, i = r.randint(0, 2), r.randint(0, len(b))
            if k == 0:
                b.insert(i, r.choice("abé"))
            elif i < len(b):
                b[i : i + 1] = [r.choice("abé")] if k == 1 else []
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for most in (1, 2, 3):
        for x in df.select("a", "b", linededup.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
            d = lev(x.a, x.b)
            assert x.d == (d if d <= most else None), (x, d)


@pytest.mark.parametrize(
    ("seed", "crowd", "threshold", "per_edit", "shortest"),
    [(1, 24, 1, 10, 10), (2, 3, 1, 10, 8), (3, 2, 1, 1, 1), (5, 24, 2, 8, 6), (6, 3, 2, 1, 2), (9, 24, 0, 10, 3)],
)
def test_line_classes_by_brute_force(spark, monkeypatch, seed, crowd, threshold, per_edit, shortest):
    """Short lines too, crowded segments, and lines that differ from many others at one place."""
    monkeypatch.setattr(linededup, "CROWD", crowd)
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(shortest, 2 * shortest + 20))) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            s = list(r.choice(base))
            if r.random() < 0.3:
                s[len(s) // 2] = r.choice("0123456789")
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k, j = r.randint(0, 2), r.randint(0, len(s))
                if k == 0:
                    s.insert(j, r.choice("xyz"))
                elif j < len(s):
                    s[j : j + 1] = [r.choice("xyz")] if k == 1 else []
            lines.append("".join(s))
        rows.append((i, "\n".join(lines) if lines else None))
    ids, occ = {}, []
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\r\f\v")
            if line:
                occ.append((i, p, ids.setdefault(line, len(ids))))
    names = list(ids)
    root = list(range(len(names)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [0] * len(names)
    for x in range(len(names)):
        for y in range(x):
            if lev(names[x], names[y]) <= min(threshold, min(len(names[x]), len(names[y])) // per_edit):
                links[x] += 1
                links[y] += 1
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, p, k in occ:
        first[find(k)] = min(first.get(find(k), (i, p)), (i, p))
    expected = sorted((i, p) for i, p, k in occ if first[find(k)] != (i, p))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.classes(df, threshold=threshold, per_edit=per_edit).collect()
    assert sorted((x.doc.id, x.pos) for x in got if not x.is_first) == expected
    many = {(x.doc.id, x.pos): x.links for x in got}
    assert all(many.get((i, p), 0) == links[k] for i, p, k in occ)
    out = {x.doc_id: x for x in linededup.dedup(df, threshold=threshold, per_edit=per_edit).collect()}
    assert sum(x.n_dropped for x in out.values()) == len(expected)
    for i, t in rows:
        if t is None:
            assert out[i].text is None
        else:
            gone = {p for d, p in expected if d == i}
            assert out[i].text == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)


def test_lines_that_differ_at_one_place(spark, monkeypatch):
    """A star of lines one letter apart: counted, not paired off, and each has a link to all others."""
    monkeypatch.setattr(linededup, "CROWD", 2)
    rows = [(i, f"a line that ends in the letter {chr(0x4E00 + i)} and goes on from there") for i in range(40)]
    rows += [(50, "a line that ends in the letter  and goes on from there"), (51, "a line that ends in the letter xy and goes on from there")]
    got = {x.doc.id: x for x in linededup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 41 and 51 not in got and [i for i, x in got.items() if x.is_first] == [0]
    assert all(got[i].links == 40 for i in [*range(40), 50])


def test_long_documents_of_dropped_lines(spark):
    import time

    text = "\n".join(f"line number {i // 2} of the long text" for i in range(200_000))
    began = time.time()
    row = linededup.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string"), threshold=0).first()
    assert time.time() - began < 60
    assert row["n_dropped"] == 100_000 and row["text"].split("\n") == [f"line number {i} of the long text" for i in range(100_000)]


def test_line_dedup_odd(spark, odd, empty):
    got = linededup.dedup(odd.withColumn("n_lines", F.lit("x"))).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.lang): r for r in got}
    assert by[1, "en"].text is None and by[2, "en"].text == "" and by[5, "en"].text == "" and by[3, None].text == "a b c d e f g"
    assert linededup.dedup(empty).count() == 0


# ---- 5 quotes ----


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I open the file?\nIt is a long one."), (1, 1, "assistant", "> How do I open\n>   the file?\n> It is a long one.\n\nUse open()."),
        (1, 2, "user", "On Monday Ann wrote:\n> > How do I open the file?\n> Use open(), it is simple.\nThanks"), (2, 0, "user", ">Use open().\nContinued elsewhere"), (2, 1, "user", "> nothing like this was ever said\nok"),
        (3, 0, "user", None), (None, 0, "user", "> x"), (4, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("thread_id", F.lit(9))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df, least=5).collect()}
    assert len(got) == len(rows)
    a = got[1, 1]
    assert (a.own_text, a.n_quotes, a.n_linked, a.reply_conv, a.reply_turn) == ("Use open().", 1, 1, 1, 0)
    b = got[1, 2]
    assert (b.own_text, b.n_quotes, b.n_linked, b.reply_turn) == ("Thanks", 2, 1, 0)
    c = got[2, 0]
    assert (c.reply_conv, c.reply_turn, c.thread_id, got[2, 1].thread_id) == (1, 1, 1, 1)
    assert got[2, 1].n_linked == 0 and got[3, 0].own_text is None and got[4, 0].own_text == "" and got[None, 0].thread_id is None
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_trimmed_quotes(spark):
    said = "The first line of it.\nThe second line of it.\nThe third line of it.\n\nAnother paragraph\nwrapped here.\n\nThe last paragraph of all."
    q = lambda t: "\n".join("> " + x for x in t.split("\n"))
    rows = [
        (5, 0, said), (5, 1, q("The second line of it.\nThe third line of it.") + "\nyes"), (5, 2, q("Another paragraph wrapped here.\n\nThe last paragraph of all.") + "\nno"),
        (5, 3, q("The first line of it.\nwords of mine") + "\nhm"), (5, 4, "Short."), (5, 5, "> Short.\nindeed"),
        (3, 0, q("The second line of it.\nThe third line of it.") + "\nA far answer, it is."), (2, 0, "> Short.\nelsewhere"),
        (6, 0, "> Words that stand in eight.\nWords that stand in six."), (8, 0, "> Words that stand in six.\nWords that stand in eight."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert len(got) == len(rows)
    for k in ((5, 1), (5, 2), (5, 3), (3, 0)):
        assert (got[k].n_linked, got[k].reply_conv, got[k].reply_turn) == (1, 5, 0), k
    assert (got[5, 5].n_linked, got[5, 5].reply_turn, got[2, 0].n_linked) == (1, 4, 0)
    assert (got[3, 0].thread_id, got[5, 0].thread_id, got[2, 0].thread_id) == (3, 3, 2)
    assert (got[6, 0].reply_conv, got[8, 0].reply_conv, got[6, 0].thread_id, got[8, 0].thread_id) == (8, 6, 6, 6)


def test_quotes_by_construction(spark):
    """Quoted runs of lines or paragraphs of an earlier message link to it, at two levels; changed quotes link to nothing."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8)))
    words = lambda: " ".join(word() for _ in range(r.randint(4, 9)))
    q = lambda t, marks="> ": "\n".join(marks + x for x in t.split("\n"))
    rows, want = [], {}
    for c in range(60):
        said = []
        for t in range(r.randint(2, 6)):
            own = "\n\n".join("\n".join(words() for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3)))
            head, expected = "", (0, 0, None)
            if said and r.random() < 0.8:
                turn, of = r.choice(said)
                kind = r.choice(["all", "lines", "lines", "paragraphs", "changed"])
                if kind == "all":
                    part = of
                elif kind == "paragraphs":
                    ps = of.split("\n\n")
                    i = r.randrange(len(ps))
                    part = "\n\n".join(ps[i : r.randint(i, len(ps) - 1) + 1])
                else:
                    ls = [x for x in of.split("\n") if x]
                    i = r.randrange(len(ls))
                    part = "\n".join(ls[i : r.randint(i, len(ls) - 1) + 1])
                if kind == "changed":
                    part = "\n".join(x[::-1] for x in part.split("\n"))
                head = (f"On {word()} {word()} wrote:\n" if r.random() < 0.3 else "") + q(part.upper() if r.random() < 0.3 else part) + "\n"
                expected = (1, 0, None) if kind == "changed" else (1, 1, turn)
            said.append((t, own))
            rows.append((c, t, head + own))
            want[c, t] = (own, *expected)
    got = {(x.conv_id, x.turn): x for x in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert all((got[k].own_text, got[k].n_quotes) == (own, n) for k, (own, n, _, _) in want.items())
    linked = [k for k, w in want.items() if w[2]]
    assert len(linked) > 60
    assert sum(got[k].n_linked == 1 and (got[k].reply_conv, got[k].reply_turn) == (k[0], want[k][3]) for k in linked) == len(linked)
    assert not any(got[k].n_linked for k, w in want.items() if not w[2])


def test_long_and_repeated_messages(spark):
    """A message of many passages is parsed in linear time; equal rows stay and link alike; ties go to the first message."""
    import time

    long = "\n".join(f"> quoted line number {i // 2}\n>> deeper line {i}" if i % 2 else f"said {i}" for i in range(40_000))
    rows = [(1, 0, "quoted line number 7"), (1, 1, long), (2, 0, "The same sentence is here."), (2, 0, "The same sentence is here."), (3, 0, "The same sentence is here."), (4, 0, "> The same sentence is here."), (4, 0, "> The same sentence is here.")]
    began = time.time()
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert time.time() - began < 60  # 40,000 lines took 38 s alone when passages grew by copies
    assert len(got) == len(rows)
    assert {(x.n_quotes, x.n_linked) for x in got if x.turn == 1} == {(40_000, 1)}
    assert [(x.reply_conv, x.reply_turn, x.thread_id) for x in got if x.conv_id == 4] == [(2, 0, 2)] * 2


def test_white_space_of_a_megabyte(spark):
    import time

    rows = [(1, 0, "a" + " " * 1_000_000 + "b"), (1, 1, " \n\n\t\n two\n\nlines \n\n"), (1, 2, " \n" * 100_000 + "x"), (1, 3, " \n")]
    began = time.time()
    got = {r["turn"]: r["own_text"] for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert time.time() - began < 60  # 80,000 spaces took 45 s by a pattern
    assert got == {0: rows[0][2], 1: " two\n\nlines", 2: "x", 3: ""}


# ---- 6 html ----


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy now</div>
    <article><h1>Title &amp; more</h1><p>First <b>bold</b> words,<br>and   more of them in a long paragraph.<p>Second one<script>var x = "</p>";</script> goes on &lt;here&gt;.</p><aside>side</aside>
    <div class="comments"><p>I say so</p></div><p>Ok.</p></article><form>Sign up</form><footer>&copy; me</footer></body></html>"""
    assert htmltext.main_text(page) == "Title & more\n\nFirst bold words, and more of them in a long paragraph.\n\nSecond one goes on <here>.\n\nOk."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav>only a menu</nav>") == ""
    assert htmltext.main_text("<article><p>cut off in the middle of a ta") == "cut off in the middle of a ta"
    assert htmltext.main_text("<article><p>cut off in a tag</p><div cla") == "cut off in a tag"
    divs = "<body><div id=menu><a>a</a><a>b</a></div><div><p>" + "long text " * 30 + "</p><p>short</p></div></body>"
    assert htmltext.main_text(divs).endswith("short")


def plain_page(r):
    """A page without article, main or telling names, and its text."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n))
    text = [words(2, 6), words(40, 90)]
    body = f"<h1>{text[0]}</h1><p>{text[1]}</p>"
    for _ in range(r.randint(1, 6)):
        kind = r.random()
        if kind < 0.6:
            text.append(words(20, 80))
            body += f"<p>{text[-1]}</p>"
        elif kind < 0.8:
            text.append(words(1, 5))
            body += f"<p>{text[-1]}</p>"
        else:
            text += [words(3, 6), words(30, 60)]
            body += f"<h2>{text[-2]}</h2><p>{text[-1][:20]}<b>{text[-1][20:30]}</b>{text[-1][30:]}</p>"
    top = f'<div class="x1"><ul>{links(r.randint(4, 9))}</ul></div>'
    end = f'<div class="x3"><div><a href="/a">{words(1, 2)}</a> <a href="/b">{words(1, 2)}</a></div><div>{words(1, 3)}</div></div>'
    inner = f'<div class="x2">{body}</div>' if r.random() < 0.5 else body
    return f"<html><body>{top}{inner}{end}</body></html>", "\n\n".join(text)


def test_pages_without_telling_names(monkeypatch):
    """Density alone finds the text; without the ratio, or without the clusters, it is not found."""
    r = random.Random(4)
    pages = [plain_page(r) for _ in range(150)]
    right = lambda: sum(htmltext.main_text(h) == t for h, t in pages)
    assert right() >= 148
    monkeypatch.setattr(htmltext, "smooth", lambda values, sigma: [1.0] * len(values))
    assert right() < 75
    monkeypatch.undo()
    monkeypatch.setattr(htmltext, "threshold", lambda values: 0.0)
    assert right() < 75


def test_telling_names_around_the_text():
    long = "<p>" + "many words of text " * 20 + "</p>"
    for page in (
        f'<div class="content has-sidebar"><ul class="menu"><li><a>one</a></li><li><a>two</a></li></ul>{long}<p>Short end.</p></div>',
        f'<form id="aspnetForm"><div class="nav"><a>a</a><a>b</a></div><div>{long}<p>Short end.</p></div></form>',
        f'<div id="page" class="no-sidebar"><article>{long}<p>Short end.</p></article><div class="related">{long}</div></div>',
    ):
        assert htmltext.main_text(page) == ("many words of text " * 20).strip() + "\n\nShort end."


def test_hostile_pages():
    import time
    import tracemalloc

    for page in ("<div>x " * 100_000, "<b>" * 100_000 + "<div></div>x" * 50_000, "<div>" * 100_000 + "x</i></b>" * 100_000, "<b><article>" + "<div>" * 50_000 + "</b>" * 50_000, "<p><li>" * 50_000, "<p>text</p>" + "<a " * 100_000, "<p>text</p>" + "<!-- x " * 100_000, "<p>text</p>" + "</b " * 100_000 + "<!--"):
        began = time.time()
        htmltext.main_text(page)
        assert time.time() - began < 8  # a quadratic one takes minutes
    tracemalloc.start()
    htmltext.main_text("<div>x " * 100_000)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_pages_that_end_within_a_tag():
    for end in ("<a href='x", "<a <b <i", "</p", "<!-- rest <p>more</p>", "<", "<!doc", "<!--"):
        assert htmltext.main_text("<article><p>Some words of text that stay here.</p>" + end) == "Some words of text that stay here." + ("\n\n<" if end == "<" else ""), end


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, "<p>" + "x " * 50000, "m")], "page_id long, html string, N_CHARS string")
    twice = sorted(htmltext.extract(df.union(df)).collect(), key=lambda r: r.n_chars)
    assert [x.n_chars for x in twice] == [0, 0, 99999, 99999]
    got = sorted(htmltext.extract(df).collect(), key=lambda r: r.n_chars)
    assert (got[0].text, got[0].n_chars, got[1].n_chars) == ("", 0, 99999)
    assert htmltext.extract(df.limit(0)).count() == 0


# ---- 7 quality ----


def slow_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_base_counts(docs):
    for t in [*docs.text, None, "", " \n \n", "a b c d e f g h " * 3, "é # *\né # *\n"]:
        assert quality.count_base(t) == slow_base(t)


def test_quality_learns_and_is_calibrated():
    r = random.Random(0)
    good = lambda: " ".join(r.choice(["the", "house", "is", "green", "and", "small"]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["THE!!", "HOUSE!!", "is***", "green%%%"]) for _ in range(40))
    data = [(good(), 1) if i % 2 else (bad(), 0) for i in range(240)]
    m = quality.fit([t for t, _ in data[:160]], [y for _, y in data[:160]])
    p, y = m.probability([t for t, _ in data[160:]]), np.array([y for _, y in data[160:]])
    assert ((p >= 0.5) == y).all() and abs(p.mean() - y.mean()) < 0.1


def test_quality_odd(odd, empty):
    m = quality.fit([], [])
    got = quality.judge(odd, m).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got)
    assert quality.judge(empty, m).count() == 0


# ---- 8 token files ----


@pytest.mark.parametrize("kind", [tokenbin.BITS, tokenbin.BYTES])
@pytest.mark.parametrize("top", [0, 1, 255, 50256, 2**32 - 1])
def test_token_file_round_trip(tmp_path, kind, top):
    ids = np.random.default_rng(0).integers(0, top + 1, 10001, dtype=np.uint64).astype("<u4")
    w = tokenbin.Writer(tokenbin.opened(str(tmp_path / "a" / "x"), "wb"), 1000, kind)
    for part in np.array_split(ids, 7):
        w.add(part)
    w.close()
    f = tokenbin.Reader(tokenbin.opened(str(tmp_path / "a" / "x"), "rb"))
    assert (np.concatenate(list(f.ranges(0, len(ids)))) == ids).all()
    assert (np.concatenate(list(f.ranges(995, 1010))) == ids[995:2005]).all()
    with pytest.raises(ValueError):
        list(f.ranges(9999, 5))
    (tmp_path / "half").write_bytes((tmp_path / "a" / "x").read_bytes()[:-5])
    with pytest.raises(ValueError):
        tokenbin.Reader(tokenbin.opened(str(tmp_path / "half"), "rb"))


def test_token_query_by_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    got = {r.doc_id: r for r in queries.op8_token_binary(spark, SMALL).collect()}
    start = 0
    d = docs.sort_values("doc_id")
    for i, e in zip(d.doc_id, t.encode_batch([x or "" for x in d.text], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", " ", "a", " b", "\n", "<|", "endoftext", "|>", "é ", "1.", "  "]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(SPECIAL, max_size=5))
def test_tokens_of_texts_that_hold_an_added_token(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = [*texts, "<|endoftext|>", "<|endoftext|> at the start", "in <|endoftext|> the middle", "at the end<|endoftext|>", "<|endoftext|><|endoftext|>", None]
    for x, ids in zip(texts, bpe.encoder_of_json(JSON, PATTERN).encode(texts), strict=True):
        assert ids.tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_token_files_odd(spark, odd, empty, tmp_path):
    enc = lambda texts: bpe.encoder_of_json(JSON, PATTERN).encode(texts)
    m = tokenbin.write_files(odd, enc, str(tmp_path / "t"), end_id=2, block=64)
    got = sorted(m.collect(), key=lambda r: r.start)
    assert got[0].doc_id is None and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [1, 1]
    back = tokenbin.read_files(m, "n bigint, crc bigint", tokenbin.crc_of_runs, ["doc_id", "start", "n_tokens"])
    assert all(r.n == r.n_tokens for r in back.collect())
    assert tokenbin.write_files(empty, enc, str(tmp_path / "e")).count() == 0


# ---- 9 BPE ----


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_query_by_the_library(spark, docs, tik):
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, SMALL).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = tik.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


TEXT = st.text(st.one_of(st.sampled_from(" \n\t.,'s!?aé中😀_1²<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_bpe_of_any_text(tik, texts):
    enc, table = bpe.encoder_of_ranks(PATH, PATTERN), bpe.token_bytes(PATH)
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == tik.encode_ordinary(t)
        assert bpe.decode_bytes(ids.tolist(), table) == t.encode()
        assert "".join(bpe.decode_pieces(ids.tolist(), table)) == t


def test_bpe_small_store(docs, tik):
    enc = bpe.PieceEncoder(bpe.tokenizer_of_ranks(bpe.read_ranks(PATH)), PATTERN, keep=50)
    for t in docs.text[:20]:
        assert enc.encode([t])[0].tolist() == tik.encode_ordinary(t)


def test_bpe_offsets_and_decoding(spark, odd, empty):
    got = bpe.encode(odd, PATH, PATTERN, offsets=True, prove=True)
    for r in got.collect():
        assert len(r.ids) == len(r.offsets) and r.round_trip
        if r.text and len(r.text) < 100:
            assert "".join(r.text[o.start : o.end] for o in r.offsets) == r.text
    back = bpe.decode(got, PATH).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.encode(empty, PATH, PATTERN).count() == 0


# ---- 10 SimHash ----


def test_trie_pairs_by_brute_force():
    rng = np.random.default_rng(0)
    u = set(map(int, rng.integers(0, 2**64, 300, dtype=np.uint64)))
    for b in rng.integers(0, 2**63, 5, dtype=np.uint64):
        for _ in range(150):
            x = int(b)
            for j in rng.choice(64, rng.integers(1, 9), replace=False):
                x ^= 1 << int(j)
            u.add(x)
    u = np.array(sorted(u), np.uint64)
    d = simhash.popcount(u[:, None] ^ u[None, :])
    ref = set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(d <= 4, 1))), strict=True))
    got = [p for a, b in simhash.trie_pairs(u, np.zeros(len(u), np.int64), 4) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(got) == ref and len(got) == len(ref)


@pytest.mark.parametrize("group", [2048, 16])
def test_simhash_components(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(0)
    base = [" ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(200):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = "zzz"
        rows.append((1000 - i, " ".join(w)))
    rows += [(5, None), (3, ""), (4, " \n"), (None, "one two"), (7, "one two")]
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for x in range(len(rows)):
        for y in range(x):
            if bin(fps[x] ^ fps[y]).count("1") <= 4:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.text): (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    for k, (i, t) in enumerate(rows):
        assert got[i, t] == (f"{fps[k]:016x}", least[find(k)])
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len({find(k) for k in range(len(rows))})
    assert sorted(x.doc_id for x in kept) == sorted(least.values())


def test_fingerprint_by_hand(docs):
    import xxhash

    for t in docs.text[:30]:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(odd).count() == 4
    assert simhash.keep_one(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 6), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and len(got) == 43
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
