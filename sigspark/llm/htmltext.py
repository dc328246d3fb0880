"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

# Elements that begin and end a line of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements whose content is never article text.
SKIPPED = frozenset("applet aside audio button canvas dialog embed footer frame frameset head header iframe input label math menu nav noembed noframes noscript object option script select style svg template textarea title video".split())
# Elements that speak against their text, which is left out unless they hold the content region.
WEAK = frozenset("fieldset form".split())
# Elements without an end tag.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
# Words of a class, id or role that mark menus, notices, adverts, comments and the like.
MARKS = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo promoted promotion related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
# Elements of running text, which stay beside dense lines though they are short.
TEXT = frozenset("blockquote caption center dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
#: A start tag of these ends an open element of the same set: html.parser does not close them itself.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: An inline end tag does not reach out of these.
CONTAINERS = frozenset("article aside body footer form header main nav".split())
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")


class Lines(HTMLParser):
    """Collects lines: (text, characters in links, number of tags, node). Nodes are the block elements: ``parent``, ``tag``
    and whether its tag or a word of its class speaks against it (``weak``). Node 0 is the page. Time and memory are linear
    in the page, however deep it nests: elements know where their names are open, and nodes know their parents only."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: (tag, node around its content, whether the content is skipped) of each open element
        self.open: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self.walls: list[int] = []
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.tag, self.weak = [0], [""], [False]
        self.parts: list[str] = []
        self.tags = self.linked = 0

    @property
    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    @property
    def skipping(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, min(self.linked, len(text)), max(1, self.tags), self.node))
        if text or self.parts:
            self.tags = 0
        self.parts, self.linked = [], 0

    def cut(self, k: int) -> None:
        """Closes the open elements from place k on."""
        for tag, _, _ in self.open[k:]:
            self.places[tag].pop()
        del self.open[k:]
        for places in (self.solid, self.walls):
            while places and places[-1] >= k:
                places.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        block = tag in BLOCKS
        if block:
            if not self.skipping:
                self.flush()
            # a new p, li or cell ends one that is open in the same container
            k = max((self.places[n][-1] for n in (*CLOSES.get(tag, ()), "p") if self.places.get(n)), default=-1)
            if k >= 0 and k >= (self.solid[-1] if self.solid else 0):
                self.cut(k)
        self.tags += 1
        if tag in VOID:
            return
        marked = tag not in ("html", "body", "article", "main") and any(k in ("class", "id", "role") and v and not MARKS.isdisjoint(WORD.findall(v.lower())) for k, v in attrs)
        skip, node = self.skipping or tag in SKIPPED or marked and not block, self.node
        if block:
            self.parent.append(node)
            self.tag.append(tag)
            self.weak.append(marked or tag in WEAK)
            node = len(self.tag) - 1
            if tag != "p":
                self.solid.append(len(self.open))
        if tag in CONTAINERS:
            self.walls.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, skip))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "b", "i", "span", "a"):  # HTML ignores the slash; only foreign elements end so
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.places.get(tag):
            return
        k = self.places[tag][-1]
        if tag not in BLOCKS and self.walls and self.walls[-1] > k:
            return
        if not self.skipping and (tag in BLOCKS or self.solid and self.solid[-1] >= k or self.places.get("p") and self.places["p"][-1] >= k):
            self.flush()
        self.cut(k)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        if not self.skipping:
            self.flush()


def without_open_end(html: str) -> str:
    """A page without the comment, or the tag, that it ends within: from the first that nothing closes."""
    at = html.find("<!--", html.rfind("-->") + 1)
    if at >= 0:
        html = html[:at]
    tag = OPEN_TAG.search(html, html.rfind(">") + 1)
    return html[: tag.start()] if tag else html


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    r = max(1, math.ceil(3 * sigma))
    g = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        w = g[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """Splits values in two clusters: the mid-point of the means of both sides, repeated until it stays."""
    t = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        if not low or not high:
            return t
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of a page: blocks in page order, joined by an empty line; empty for null or a page without text.

    The ratio of a line is its characters outside of links for each tag, and a tenth of that within an element that speaks
    against it. Lines whose smoothed ratio is in the upper cluster are dense. They choose the region: the outermost article
    or main with half of their text, else the innermost element with nine tenths of it. From there it grows: see ``_grown``.
    Elements with telling names weigh a line down and are left out of the region, but not where they hold the region.
    """
    if not html:
        return ""
    p = Lines()
    p.feed(without_open_end(html))
    p.finish()
    if not p.lines:
        return ""
    against = list(p.weak)
    for i in range(1, len(against)):
        against[i] = against[i] or against[p.parent[i]]
    ratio = [(len(t) - 0.9 * links) / tags * (0.1 if against[i] else 1) for t, links, tags, i in p.lines]
    if max(ratio) < 2.5 and all(against[i] for _, _, _, i in p.lines):
        return ""  # nothing but short lines in forms, notices and the like
    flat = smooth(ratio, sigma)
    cut = threshold(flat)
    dense = [r >= cut for r in flat]
    votes = [0] * len(p.tag)
    for (t, _, _, i), d in zip(p.lines, dense, strict=True):
        votes[i] += len(t) * d
    total = sum(votes)
    for i in range(len(votes) - 1, 0, -1):  # a parent comes before its children
        votes[p.parent[i]] += votes[i]
    region = next((i for i, v in enumerate(votes) if p.tag[i] in ("article", "main") and 2 * v >= total), None)
    named = region is not None
    if not named:
        region = max((i for i, v in enumerate(votes) if 10 * v >= 9 * total and (i == 0 or p.tag[i] not in SMALL)), default=0)
    firm = [d and 4 * r >= cut for d, r in zip(dense, ratio, strict=True)]  # not dense by its neighbours alone
    return "\n\n".join(_grown(p, region, named, firm))


#: Elements too small to be a region.
SMALL = frozenset("blockquote h1 h2 h3 h4 h5 h6 li p pre td th tr".split())


def _grown(p: Lines, region: int, named: bool, dense: list[bool]) -> list[str]:
    """The lines of the region that belong to its dense ones.

    What stands right under the region is a unit: an element with all it holds, or a line of its own. Units with a dense line
    stay. Others stay where less than half of their text is in links and they are of running text or of a kind that the
    dense units are; in an article or main, whatever their kind. Within a unit, an element with a telling name goes.
    """
    size = len(p.tag)
    unit, out = [-1] * size, [False] * size
    for i in range(1, size):
        up = p.parent[i]
        if up == region:
            unit[i], out[i] = i, p.weak[i]
        elif unit[up] >= 0:
            unit[i], out[i] = unit[up], out[up] or p.weak[i]
    rows = []
    for k, (t, links, _, i) in enumerate(p.lines):
        if i == region:
            rows.append((-1 - k, t, links, dense[k]))
        elif unit[i] >= 0 and not out[i]:
            rows.append((unit[i], t, links, dense[k]))
    kinds, chars, linked, firm = set(), {}, {}, set()
    for u, t, links, d in rows:
        chars[u] = chars.get(u, 0) + len(t)
        linked[u] = linked.get(u, 0) + links
        if d:
            firm.add(u)
            kinds.add(p.tag[u] if u >= 0 else "")
    stays = lambda u: u in firm or 2 * linked[u] < chars[u] and (named or (tag := p.tag[u] if u >= 0 else "") in kinds or tag in TEXT)
    return [t for u, t, _, _ in rows if stays(u)]


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None, sigma: float = 1.0) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (its code points) to every row; no shuffle, one page in memory at a time.

    Null, empty and tag-only pages give an empty text. Columns of ``df`` with these names give way.
    """

    def kernel(pages: list[str | None]) -> list[list]:
        texts = [main_text(h, sigma) for h in pages]
        return [texts, [len(t) for t in texts]]

    return map_text(df, html, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], kernel, keep)
