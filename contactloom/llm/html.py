"""Main text of web pages from a stream of parser events.

The standard-library parser's events become lines, one for each run of text
between block tags. Every line has a ratio of text to tags; ratios are smoothed
with a Gaussian along the page and split by a threshold between the mean of the
text-poor and that of the text-rich lines. The content region is the innermost
element that holds nearly all text-rich lines (an article or main element if one
does); its lines are the text, without those inside elements that are never
content (menus, footers, scripts, forms, adverts, comments and the like).

Defined cases: NULL and empty pages give an empty text; repeated rows are read one
by one; an empty table gives no rows; unclosed and crossing tags are closed as
browsers do for paragraphs; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input label map math menu nav noscript object option script select "
    "style svg template textarea title video".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notification|alert|comments?|disqus|repl(?:y|ies)|sidebar|side|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|popup|modal|"
    r"overlay|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
_SPACE = re.compile(r"\s+")
SIGMA, RADIUS = 1.0, 3


class _Lines(HTMLParser):
    """Collects (text, tags, innermost element, never content)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        #: elements in the order of their start tags; those inside element n are n to ends[n] - 1
        self.names: list[str] = ["page"]
        self.ends: dict[int, int] = {}
        self.held: Counter[str] = Counter()  # open elements by name
        self.open: list[tuple[str, int, bool]] = [("page", 0, False)]
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags + 1, self.open[-1][1], self.open[-1][2]))
            self.tags = 0
        self.parts = []

    def _hidden(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER or tag == "header" and not (self.held["article"] or self.held["main"]):
            return True
        for key, value in attrs:
            if key in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main") and _NAMED.search(value):
                return True
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and "display:none" in value.replace(" ", ""):
                return True
        return False

    def _pop_to(self, tags: set[str] | frozenset[str], walls: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                for t, n, _ in self.open[k:]:
                    self.ends[n] = len(self.names)
                    self.held[t] -= 1
                del self.open[k:]
                return
            if self.open[k][0] in walls:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self._pop_to({"p"}, frozenset(("table", "td", "th", "button", "article", "section", "div", "body", "li")))
            if tag in SAME:
                self._pop_to(SAME[tag], frozenset(("ul", "ol", "dl", "table")))
        elif tag in ("br", "img", "wbr"):
            self.parts.append(" " if tag != "wbr" else "")
        if tag in VOID:
            return
        hidden = self._hidden(tag, attrs)
        if tag not in BLOCK and not hidden:
            return  # plain inline elements take no part in the structure
        if hidden and tag not in BLOCK:
            self.flush()
        self.names.append(tag)
        self.held[tag] += 1
        self.open.append((tag, len(self.names) - 1, hidden or self.open[-1][2]))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or tag in NEVER or self.held[tag]:
            self.flush()
            if self.held[tag]:
                self._pop_to({tag}, frozenset())

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _smoothed(x: list[float]) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - RADIUS), min(len(x), i + RADIUS + 1)
        w = kernel[lo - i + RADIUS : hi - i + RADIUS]
        out.append(round(sum(a * b for a, b in zip(w, x[lo:hi], strict=True)) / sum(w), 9))  # equal ratios stay equal
    return out


def _threshold(x: list[float]) -> float:
    """The middle between the means of the low and of the high values."""
    cut = sum(x) / len(x)
    for _ in range(20):
        low, high = [v for v in x if v < cut], [v for v in x if v >= cut]
        if not low or not high:
            return min(x)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str | None) -> str:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.lines
    if not any(not never for _, _, _, never in lines):
        return ""
    ratio = _smoothed([0.0 if never else len(text) / tags for text, tags, _, never in lines])
    cut = _threshold(ratio)
    # text-rich characters before each element, then inside it
    rich = [0] * (len(parser.names) + 1)
    for (text, _, n, never), r in zip(lines, ratio, strict=True):
        if r >= cut and not never:
            rich[n + 1] += len(text)
    before = list(itertools.accumulate(rich))
    end = [parser.ends.get(n, len(parser.names)) for n in range(len(parser.names))]
    held = [before[e] - before[n] for n, e in enumerate(end)]
    total = before[-1]
    named = [n for n, v in enumerate(held) if v >= 0.8 * total and v and parser.names[n] in ("article", "main")]
    region = max(named) if named else max((n for n, v in enumerate(held) if parser.names[n] != "p" and v and v >= 0.95 * total), default=0)
    return "\n\n".join(text for text, _, n, never in lines if not never and region <= n < end[region])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
