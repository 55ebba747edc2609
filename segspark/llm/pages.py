"""Main text of web pages: text-to-tag ratios, smoothed and clustered, over a streaming parser's events.

The standard library's parser feeds events in page order; a block element starts a new line, and each line
keeps its text, its number of tags and whether it lies within boilerplate (navigation, page header and footer,
sidebar, notice, advert, form, script, style, reader comments, by element, role or class). The ratio of text to
tags of the lines is smoothed with a Gaussian and split in two clusters by one-dimensional 2-means; lines of
the upper cluster vote with their text for the elements around them. The content region is the element with
the most votes: an article or main element first, else the innermost one that holds nearly all of them. All
its lines outside boilerplate are the text, short ones too: the cluster selects regions, not single lines. Around a region
that is an article or main element, headings and other lines of the outermost such element belong to the text as
well, unless they are boilerplate or, headings aside, more than half link text. Around any other region, lines of
the upper cluster do, and headings and paragraphs right beside the region or an element that holds it; sidebars and menus without telling
names fall to the lower cluster and stay out. All steps take time in proportion to the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import lean, read

# Fixed values of HTML: elements that start a line, have no end tag, hold no text of the page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg math object canvas audio video head title select datalist textarea button".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names.
NAMES = frozenset("nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets notice notices cookie cookies consent gdpr banner alert ad ads advert adverts advertisement advertising sponsor sponsored promo promotion form search login signup subscribe subscription newsletter comment comments commentlist disqus reply replies respond discussion share sharing social related recommended pagination pager popup modal overlay toolbar skip copyright".split())
#: Names that an outer wrapper may have for its layout (as in "with-sidebar"): an article or main element inside counts all the same.
LAYOUT = frozenset("nav navbar navigation header masthead footer sidebar aside widget widgets menu topbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = frozenset("p blockquote pre figure".split())
_P_ENDS = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption"}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Events to lines: text, tags, boilerplate, and the element they are in (a path of element numbers)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # tag, element number, boilerplate from here down: 0 no, 1 by layout name, 2 yes
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements by tag
        self.walls: list[int] = []  # of open elements that aren't inline
        self.elements: list[tuple[int, str]] = []  # parent number, tag
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, bool, int]] = []
        self.link = False  # inside a link
        self.linked = 0  # characters of the line in links
        self.mostly_links: list[bool] = []  # of each line
        self.inline: int | None = None  # how many elements were open before the dropped one within a line, while inside it

    def _end_line(self) -> None:
        if self.inline is not None:  # the line goes on after the dropped element
            return
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, bool(self.open and self.open[-1][2]), self.open[-1][1] if self.open else -1))
            self.mostly_links.append(2 * self.linked > len(text))
            self.tags = 0
        self.linked = 0
        self.text.clear()

    def _dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in HIDDEN or tag in BOILERPLATE:
            return 2
        inside = bool(self.places["article"] or self.places["main"])
        if tag == "header":
            return 0 if inside else 2
        a = dict(attrs)
        if "hidden" in a or (a.get("aria-hidden") or "") == "true" or re.search(r"display\s*:\s*none", a.get("style") or ""):
            return 2
        if (a.get("role") or "").lower() in ROLES:
            return 2
        if tag in ("html", "body"):
            return 0
        words = {w.lower() for k in ("class", "id") for name in (a.get(k) or "").split() for w in [name, *_SPLIT.split(name)]}
        found = words & NAMES
        if tag in ("article", "main"):
            found -= LAYOUT
        if inside:
            found -= {"header"}
        return 2 if found - LAYOUT else 1 if found else 0

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in BLOCK and tag != "title" and self.inline is None:
            self.inline = len(self.open)
        _, parent, above = self.open[-1] if self.open else ("", -1, 0)
        if above == 1 and tag in ("article", "main"):
            above = 0
        self.elements.append((parent, tag))
        self.places[tag].append(len(self.open))
        if tag in BLOCK or tag in HIDDEN:
            self.walls.append(len(self.open))
        self.open.append((tag, len(self.elements) - 1, max(above, self._dropped(tag, attrs))))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "a":
            self.link = any(k == "href" for k, _ in attrs)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID and tag != "hr":
            return
        if tag in BLOCK or tag in HIDDEN:
            if tag in BLOCK or tag == "title":
                self._end_line()
            if tag in _P_ENDS and self.places["p"] and self.walls[-1] == self.places["p"][-1]:
                self._close("p")
            if tag == "li" and self.places["li"] and not any(self.places[t] and self.places[t][-1] > self.places["li"][-1] for t in ("ul", "ol", "menu")):
                self._close("li")
            if tag == "hr":
                return
            self._push(tag, attrs)
        elif attrs and self._dropped(tag, attrs):
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag in BLOCK:
            self._end_line()

    def _cut(self, i: int) -> None:
        """Forget open elements from place i on; each goes once."""
        for tag, _, _ in self.open[i:]:
            self.places[tag].pop()
        while self.walls and self.walls[-1] >= i:
            self.walls.pop()
        del self.open[i:]

    def _close(self, tag: str) -> None:
        """Close the innermost open element of this tag, with all in it."""
        if not self.places[tag]:
            return
        i = self.places[tag][-1]
        if self.inline is not None and i < self.inline:  # left open
            self._cut(self.inline)
            self.inline = None
        if self.inline == i:
            self.inline = None
        elif tag in BLOCK or tag == "title":
            self._end_line()
        self._cut(i)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = False
        if tag in BLOCK or tag in HIDDEN:
            if tag in BLOCK:
                self._end_line()
            self._close(tag)
        elif self.open and self.open[-1][0] == tag:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.inline is not None or (self.open and self.open[-1][0] in HIDDEN):
            return
        if self.link:
            self.linked += len(_SPACE.sub(" ", data).strip())
        self.text.append(data)

    def close(self) -> None:
        super().close()
        if self.inline is not None:
            self._cut(self.inline)
            self.inline = None
        self._end_line()


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian over neighbouring lines, the ends repeated."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def threshold(x: np.ndarray) -> float:
    """The border between the two clusters of 2-means on a line, from the ends of the range."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(32):
        upper = x >= (lo + hi) / 2
        if upper.all():
            break
        was = (lo, hi)
        lo, hi = float(x[~upper].mean()), float(x[upper].mean())
        if was == (lo, hi):
            break
    return (lo + hi) / 2


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.9) -> str:
    """The page's main text, its blocks joined by newlines; empty for null, empty and textless pages."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    lines = p.lines
    if not any(not dropped for _, _, dropped, _ in lines):
        return ""
    ratio = np.array([0.0 if dropped else len(text) / max(1, tags) for text, tags, dropped, _ in lines])
    smoothed = smooth(ratio, sigma)
    limit = threshold(smoothed)
    upper = (smoothed >= limit).tolist()
    # An element's number is below those of all that it holds, so one pass from the last adds votes up, and one from the
    # first finds what is inside.
    votes = [0] * len(p.elements)
    total = 0
    for (text, _, dropped, at), high in zip(lines, upper, strict=True):
        if high and not dropped:
            total += len(text)
            if at >= 0:
                votes[at] += len(text)
    for i in range(len(p.elements) - 1, -1, -1):
        if p.elements[i][0] >= 0:
            votes[p.elements[i][0]] += votes[i]
    best = max((i for i, (_, tag) in enumerate(p.elements) if tag in ("article", "main") and votes[i] > 0.5 * total), default=-1)
    if best < 0:
        best = max((i for i in range(len(p.elements)) if total and votes[i] >= share * total and p.elements[i][1] not in ("p", "li", "td", "pre", "blockquote") and p.elements[i][1] not in HEADINGS), default=-1)
    if best < 0:
        return "\n".join(text for text, _, dropped, _ in lines if not dropped)
    article = p.elements[best][1] in ("article", "main")
    above, up = set(), p.elements[best][0]
    while up >= 0:
        above.add(up)
        up = p.elements[up][0]
    around = min((i for i in above | {best} if p.elements[i][1] in ("article", "main")), default=best)
    inside, near = [False] * len(p.elements), [False] * len(p.elements)
    for i, (parent, _) in enumerate(p.elements):
        inside[i] = i == best or (parent >= 0 and inside[parent])
        near[i] = i == around or (parent >= 0 and near[parent])

    def kept(at: int, links: bool, high: bool) -> bool:
        if at < 0:
            return not article and high and not links
        parent, tag = p.elements[at]
        if article:
            return inside[at] or (near[at] and (not links or tag in HEADINGS))
        beside = parent < 0 or parent in above
        return inside[at] or (tag in HEADINGS and beside) or (not links and (high or (tag in TEXT and beside)))

    return "\n".join(text for (text, _, dropped, at), links, high in zip(lines, p.mostly_links, upper, strict=True) if not dropped and kept(at, links, high))


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": [main_text(h) for h in f["html"]]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages; other columns are ignored, ids and urls kept as they are.

    Null and empty html give an empty text. Very long and deep pages take time and memory in proportion to their size.
    Rows are independent: repeated rows and null ids give repeated results, clashing names of other columns don't matter, no
    rows give none.
    """
    lean(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInPandas(_extract, "page_id long, url string, text string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
