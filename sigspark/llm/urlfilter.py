"""URL filter: a weighted vocabulary matched by an Aho-Corasick automaton, under host and path rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, with_columns_replaced

# One of these in a url rejects it.
STRICT = ("bestiality", "casino", "escorts", "gambling", "hentai", "milf", "nude", "porn", "porno", "pornhub", "sportsbook", "viagra", "warez", "xvideos", "xxx")
# Two different ones reject a url.
SOFT = ("adult", "babes", "bet", "bonus", "cams", "chat", "cheap", "crack", "dating", "download", "erotic", "escort", "free", "hot", "jackpot", "keygen", "loan", "naked", "pills", "poker", "serial", "sex", "sexy", "slots", "torrent", "webcam")


@dataclass(frozen=True)
class Rule:
    """Rows whose host is ``host`` or ends in ``.host`` and whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


LOWER = str.maketrans(UPPER, UPPER.lower())


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            a.add_word(t, (kind, t))
    a.make_automaton()
    return a


def count_terms(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and soft terms that stand between characters other than a-z and 0-9."""
    s = (url or "").translate(LOWER)
    word = "abcdefghijklmnopqrstuvwxyz0123456789"
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for end, (kind, term) in automaton(strict, soft).iter(s):
        start = end - len(term) + 1
        if (start == 0 or s[start - 1] not in word) and (end + 1 == len(s) or s[end + 1] not in word):
            found[kind].add(term)
    return len(found["strict"]), len(found["soft"])


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = 2) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict``, ``n_strict`` and ``n_soft`` to every row.

    The longest rule that fits gives the verdict. Without one, the vocabulary does: ``block`` for a strict term or
    ``soft_limit`` different soft terms, else ``allow``. A null or empty url, or one without ``://``, has an empty host and
    path and fits no rule; null counts no term and is allowed. The work is local to a row: no shuffle, so repeated or
    frequent urls and hosts cost nothing extra. Columns of ``df`` with these names give way.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules with the same host and path")

    @F.pandas_udf("n_strict int, n_soft int")
    def terms(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_terms(u, strict, soft) for u in urls], columns=["n_strict", "n_soft"])

    u = F.col(f"`{url}`")
    out = with_columns_replaced(df, {"host": host_of(u), "path": path_of(u), "__terms": terms(u)})
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("__terms.n_strict") > 0) | (F.col("__terms.n_soft") >= soft_limit), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = (F.concat(F.lit("."), F.col("host")).endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    out = with_columns_replaced(out, {"rule": rule, "verdict": verdict, "n_strict": F.col("__terms.n_strict"), "n_soft": F.col("__terms.n_soft")})
    return out.drop("__terms")
