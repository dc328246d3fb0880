"""Quotation linking in conversations, with DataFrame functions only.

A message is cut in lines; the marks ``>`` at the head of a line give its quote level. Lines of one level in a row are a
passage. Passages are normalised (lower case, white space to one space) and hashed, and so are the paragraphs, the lines and
the whole of what each message says itself, and its runs of lines and of paragraphs that begin like a passage and are as
long; equal hashes link a passage to the first message that says it. A passage that nobody says as it stands is looked up by
its paragraphs, then by its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, with_columns_replaced
from .components import components

MARKS = r"^(?:[ \t]*>)+"
# What a line that names the author of a quote ends in.
SAYING = "wrote|writes|said|says|schrieb|schreibt|escribió|dijo|a écrit"


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def level_of(line: Column) -> Column:
    """The number of quote marks at the head of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))


def _parsed(text: Column) -> Column:
    """(level, body) of each line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, MARKS + "[ \t]?", "").alias("body")))


def passages(lines: Column) -> Column:
    """Runs of lines of one level above 0: (level, body), in order; in time linear in the lines."""

    def cut_out(ls: Column) -> Column:
        level = lambda i: F.try_element_at(ls, i)["level"]
        quoted = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: level(i) > 0)
        starts = F.filter(quoted, lambda i: (i == 1) | (level(F.greatest(i - 1, F.lit(1))) != level(i)))
        ends = F.filter(quoted, lambda i: (i == F.size(ls)) | (level(F.least(i + 1, F.size(ls))) != level(i)))
        body = lambda x: F.array_join(F.transform(F.slice(ls, x["a"], x["b"] - x["a"] + 1), lambda line: line["body"]), "\n")
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(level(x["a"]).alias("level"), body(x).alias("body")))

    return let(lines, cut_out)


def paragraphs(c: Column) -> Column:
    return F.split(c, r"\n\s*\n")


def units(c: Column) -> Column:
    """The normalised lines and the normalised paragraphs of a text, without empty ones: two arrays."""
    clean = lambda parts: F.filter(F.transform(parts, normal), lambda x: x != "")
    return F.array(clean(F.split(c, "\n")), clean(paragraphs(c)))


def _runs(said: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key``, ``c``, ``t`` of the runs of units of what is said that begin with a unit ``f`` and have ``k`` units.

    ``wanted``: the ``f`` and ``k`` of passages, each once; so a place in a message meets each length once, however many
    passages begin alike, and only places and numbers are joined.
    """
    rows = said.select("c", "t", F.xxhash64("own").alias("m"), F.posexplode(units(F.col("own"))).alias("kind", "us")).where(F.size("us") > 1)
    at = rows.select("c", "t", "m", "kind", F.posexplode("us").alias("i", "u")).select("c", "t", "m", "kind", "i", F.xxhash64("u").alias("f"))
    met = at.join(wanted, ["kind", "f"]).groupBy("c", "t", "m", "kind").agg(F.collect_set(F.struct("i", "k")).alias("places"))
    fits = F.filter("places", lambda p: p["i"] + p["k"] <= F.size("us"))
    runs = rows.join(met, ["c", "t", "m", "kind"]).select("c", "t", F.explode(F.transform(fits, lambda p: F.xxhash64(F.array_join(F.slice("us", p["i"] + 1, p["k"]), " ")))).alias("key"))
    return runs.select("key", "c", "t")


def own_text(lines: Column) -> Column:
    """What a message says itself: the lines without marks, without empty lines at the ends."""
    text = F.rtrim(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), F.lit(" \t\n\x0b\f\r"))
    return F.regexp_replace(text, r"\A\s*\n", "")


def _attribution(text: Column) -> Column:
    """Without a line like ``On Monday Ann wrote:`` before a quote, however long it is."""
    return F.regexp_replace(text, rf"(?m)^[^\n>]*\b(?:{SAYING})\s?:[ \t]*(?=\n[ \t]*>)", "")


def link_quotes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", least: int = 12, rounds: int = 60) -> DataFrame:
    """Adds to each message ``own_text``, ``n_quotes``, ``n_linked``, ``reply_conv``, ``reply_turn`` and ``thread_id``.

    Passages are looked up first in their own conversation at earlier turns, then, from ``least`` characters on, in all
    other conversations; the first message (by conversation, turn) that says a passage, or a run of lines or paragraphs
    equal to it, is the original. Where there is none, that of the first paragraph of the passage that has one, then of the
    first line, of ``least`` characters and more. ``reply_*`` is the original of the first linked passage of the lowest
    level. A conversation whose earliest message replies to another conversation continues it: ``thread_id`` is the smallest
    of the conversations that such replies connect, in a circle or not. Ordered by (thread_id, conversation, turn), with
    ``own_text`` for text, messages are conversations without quotes; within a conversation an original always comes before
    its replies. Numbers of conversations say nothing of time, so an original in another one may have the larger number.

    A null text says and quotes nothing; null conversations or turns link to nothing and are a thread of their own (null).
    Repeated rows link alike. Originals are aggregates by hash, so a sentence or a conversation that a third of all rows
    share is one row in each join. Columns of ``df`` with these names give way.
    """
    lines = _parsed(_attribution(F.col(f"`{text}`")))
    base = df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("h"), lines.alias("ls"))
    base = base.where("c is not null and t is not null")
    quoted = base.where(F.exists("ls", lambda x: x["level"] > 0)).select("c", "t", "h", F.posexplode(passages(F.col("ls"))).alias("pos", "p"))
    body = F.col("p.body")
    quoted = cut(quoted.select("c", "t", "h", "pos", F.col("p.level").alias("level"), body.alias("body")).distinct())
    body = F.col("body")
    piece = lambda rank: lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), normal(x).alias("s"))
    parts = F.concat(F.transform(F.array(body), piece(0)), F.transform(paragraphs(body), piece(1)), F.transform(F.split(body, "\n"), piece(2)))
    looked = quoted.select("c", "t", "h", "pos", "level", F.explode(parts).alias("x"))
    looked = looked.select("c", "t", "h", "pos", "level", "x.rank", "x.at", F.xxhash64("x.s").alias("key"), F.length("x.s").alias("n"))
    looked = cut(looked.where((F.col("n") >= least) | (F.col("rank") == 0) & (F.col("n") > 0)))
    keys = looked.select("key").distinct()
    wanted = quoted.select(F.posexplode(units(body)).alias("kind", "us")).where(F.size("us") > 1)
    wanted = cut(wanted.select("kind", F.xxhash64(F.col("us")[0]).alias("f"), F.size("us").alias("k")).distinct())

    own = own_text(F.col("ls"))
    said = base.select("c", "t", own.alias("own")).where("own <> ''")
    parts = F.array_distinct(F.concat(F.array(F.col("own")), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")))
    whole = said.select("c", "t", F.explode(parts).alias("part")).select(F.xxhash64(normal(F.col("part"))).alias("key"), "c", "t")
    said = (whole if wanted.isEmpty() else whole.union(_runs(said, wanted))).join(keys, "key", "left_semi")
    said = cut(said.groupBy("key", "c").agg(F.min("t").alias("t")))
    anywhere = cut(said.groupBy("key").agg(F.min(F.struct("c", "t")).alias("o")))
    beside = said.join(anywhere, "key").where("c <> o.c").groupBy("key").agg(F.min(F.struct("c", "t")).alias("o2"))
    anywhere = anywhere.join(beside, "key", "left")
    near = looked.join(said.select("key", "c", F.col("t").alias("ot")), ["key", "c"], "left")
    near = near.withColumn("ot", F.when(F.col("ot") < F.col("t"), F.col("ot")))
    found = near.join(anywhere, "key", "left").select(
        "c", "t", "h", "pos", "level", "rank", "at",
        F.when(F.col("ot").isNotNull(), F.struct(F.col("c").alias("c"), F.col("ot").alias("t"))).when(F.col("n") >= least, F.when(F.col("o.c") != F.col("c"), F.col("o")).otherwise(F.col("o2"))).alias("o"),
    )
    found = found.where("o is not null").groupBy("c", "t", "h", "pos", "level").agg(F.min(F.struct("rank", "at", "o")).alias("first"))
    found = found.select("c", "t", "h", "pos", "level", F.col("first.o").alias("o"))
    per = quoted.groupBy("c", "t", "h").agg(F.count("*").alias("n_quotes"))
    linked = found.groupBy("c", "t", "h").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "pos", "o")).alias("best"))
    linked = cut(per.join(linked, ["c", "t", "h"], "left").select("c", "t", "h", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("best.o").alias("o")))

    heads = base.groupBy("c").agg(F.min("t").alias("t"))
    jumps = linked.where("o.c <> c").join(heads, ["c", "t"], "left_semi").groupBy("c").agg(F.min("o.c").alias("root"))
    jumps = components(jumps, "c", "root", rounds).select(F.col("node").alias("c"), "root")

    rows = df.withColumn("__c", F.col(f"`{conv}`")).withColumn("__t", F.col(f"`{turn}`")).withColumn("__h", F.xxhash64(F.col(f"`{text}`")))
    rows = rows.join(linked.select(*[F.col(x).alias(f"__{x}") for x in ("c", "t", "h", "n_quotes", "n_linked", "o")]), ["__c", "__t", "__h"], "left")
    rows = rows.join(jumps.select(F.col("c").alias("__c"), F.col("root").alias("__root")), "__c", "left")
    made = {
        "own_text": F.when(F.col(f"`{text}`").isNotNull(), own_text(_parsed(_attribution(F.col(f"`{text}`"))))),
        "n_quotes": F.coalesce("__n_quotes", F.lit(0)).cast("bigint"),
        "n_linked": F.coalesce("__n_linked", F.lit(0)).cast("bigint"),
        "reply_conv": F.col("__o.c"),
        "reply_turn": F.col("__o.t"),
        "thread_id": F.coalesce("__root", "__c"),
    }
    return with_columns_replaced(rows, made).drop("__c", "__t", "__h", "__n_quotes", "__n_linked", "__o", "__root")
