"""Main text of a page by line-block distribution.

Markup is stripped to one line per block element; lines get their text length; the sums over a sliding window of lines are
the line-block distribution. Text surges where a window first rises over the threshold and dives where it falls to it
again; what lies between is kept. Lines of elements that are never main text (navigation, headers and footers of the page,
sidebars, forms, adverts, comments) count as length 0 and are not kept, so they make the distribution fall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

#: Fixed lists of element names and of words in class and id attributes.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas audio video textarea select".split())
BOILER = frozenset("nav footer aside form menu dialog button head title".split())
CLOSED_BY = {"p": BLOCKS - {"br", "hr", "button", "option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|subscription|social|share|sharing|nav\w*|menu|breadcrumbs?|footer|"
    r"masthead|topbar|sidebar|widget|related|recommend\w*|comments?|replies|respond|disqus|login|signup|pagination|pager|hidden|copyright|disclaimer|toolbar)(?:$|[\s_-])",
    re.I,
)
REMARK = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MAIN = frozenset({"article", "main"})

_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")

WINDOW, SURGE = 3, 40


class _Lines(HTMLParser):
    """(text, boilerplate?, in article or main?, list or link share) of each block, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack: list[tuple[str, bool]] = []  # open elements; does it start boilerplate?
        self.places: dict[str, list[int]] = {}  # in the stack, by name
        self.blocks: list[int] = []  # in the stack, of block elements
        self.boiler = self.main = self.link = 0
        self.parts: list[str] = []
        self.linked = 0
        self.lines: list[tuple[str, bool, bool, float]] = []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.boiler > 0, self.main > 0, self.linked / max(1, len(text))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        while self.stack and tag in CLOSED_BY.get(self.stack[-1][0], ()):
            self.pop()
        if tag in BLOCKS or tag in RAW:
            self.flush()
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        marked = tag not in ("html", "body") and bool(MARKS.search(a.get("class", "")) or MARKS.search(a.get("id", "")) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I))
        page_header = tag == "header" and not self.main
        boiler = tag in BOILER or tag in RAW or marked and (tag not in MAIN or bool(REMARK.search(a.get("class", "")))) or page_header
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, boiler))
        self.boiler += boiler
        self.main += tag in MAIN
        self.link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()

    def pop(self):
        tag, boiler = self.stack[-1]
        if tag in BLOCKS or tag in RAW:
            self.flush()
        self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.boiler -= boiler
        self.main -= tag in MAIN
        self.link -= tag == "a"

    def handle_endtag(self, tag):
        if not self.places.get(tag):
            if tag in BLOCKS:
                self.flush()
            return
        at = self.places[tag][-1]
        # an inline end tag doesn't close blocks, which it would cross
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
            return
        while len(self.stack) > at:
            self.pop()

    def handle_data(self, data):
        self.parts.append(data)
        if self.link:
            self.linked += len(data.strip())

    def parse_marked_section(self, i, report=1):
        """A marked section is a comment that ends with the next ``>``."""
        return self.rawdata.find(">", i) + 1 or -1

    def close(self):
        if _UNFINISHED.match(self.rawdata):  # a tag or comment that the page's end cuts is no text
            self.rawdata = ""
        super().close()

    def handle_entityref(self, name):
        self.handle_data(unescape(f"&{name};") if unescape(f"&{name};") != f"&{name};" else unescape(f"&{name}"))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))


def lines(html: str) -> list[tuple[str, bool, bool, float]]:
    p = _Lines()
    p.feed(html)
    p.close()
    while p.stack:
        p.pop()
    p.flush()
    return p.lines


def zones(weight: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, end) of the stretches of lines that are text, from the lines' lengths.

    The distribution is the sum of lengths over ``window`` lines around each. A stretch runs from where it leaves 0 to where it
    dives back to 0, and counts if it surges to ``surge`` (or to the highest sum of the page, if that is lower).
    """
    n, half = len(weight), window // 2
    upto = [0, *accumulate(weight)]
    sums = [upto[min(n, i + half + 1)] - upto[max(0, i - half)] for i in range(n)]
    least = min(surge, max(sums, default=0))
    out, at = [], 0
    while at < n:
        first, top = at, 0
        while at < n and sums[at]:
            top = max(top, sums[at])
            at += 1
        if top and top >= least:
            out.append((first, at))
        at = max(at, first + 1)
    return out


def extract(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Blocks joined by one newline; '' if there are none: the lines with a length in the zones of the distribution.

    A line of boilerplate, or of links outside an article or main element, has length 0.
    """
    if not html:
        return ""
    found = lines(html)
    weight = [0 if b or (linked > 0.5 and not m) else len(t) for t, b, m, linked in found]
    return "\n".join(found[i][0] for first, end in zones(weight, window, surge) for i in range(first, end) if weight[i])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null or empty html gives '' and 0; null ids and urls stay null; broken markup is read as browsers do (a tag that the end of
    the page cuts is dropped); pages of any length are read whole, in time linear in it; repeated rows and ids give a row each;
    extra columns are ignored, whatever their names; an empty table gives no rows. No order matters. Each row is worked on by
    itself: no shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = [extract(h, window, surge) for h in f.pop("html")]
            yield f

    common.ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
