"""HTML extraction: parser events, text-to-tag ratios per line, Gaussian smoothing and threshold clustering.

The standard library's streaming parser turns a page into lines, one for each block (paragraph, heading, list item,
table cell and so on), with its text, its number of tags and the characters that are links. Parts that can't be main text
by their element, role or a whole class name or id (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
make no lines. Of the rest, the logarithm of the ratio of text to tags is smoothed along the page with a Gaussian; two clusters (the low one at
zero, the mean of the high one found by iteration) set the threshold, and on every page the lines that reach it are the content regions.
Lines that are mostly links and lie between lines of a region belong to it.

A mark of the article (`article`, `main`, the matching roles or class names) is a feature of the ratio and decides nothing by itself: marked
lines count links as text and have at least the mean of the marked lines, so that short headings and list items follow
their article; other lines of such a page have half their value. Elsewhere only characters outside links are text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one \\n. Null and empty
pages give the empty text. Unclosed and stray tags are tolerated; a hidden part left open ends with the block that encloses it.
Repeated rows give equal results; extra columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelab.llm.common import table

# Elements by their part in a page, and words of classes and ids that name parts other than the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                    "hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul").split())
HIDDEN = frozenset(("script style noscript template head title iframe object canvas svg math audio video map "
                    "nav header footer aside form button select textarea input dialog menu search").split())
RAW = frozenset("script style".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset((
    "ad ads advert adverts advertisement advertisements advertising adbox adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets "
    "ad-box ad-banner ad-container ad-slot ad-unit ad-wrapper nav-bar nav-menu main-nav main-menu site-nav site-navigation site-header site-footer side-bar "
    "cookie-notice cookie-banner cookie-bar cookie-consent share-buttons social-links social-share related-posts comment-list comments-area "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies disqus share sharing social related recommended pagination pager toolbar").split())
ARTICLE_MARKS = frozenset("article-body article-content articlebody entry-content main-content post-body post-content story-body".split())
HEAD = frozenset("base link meta title style script noscript template".split())
UNMARKED = 0.5
_SPACE = re.compile(r"\s+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    article: bool = False


def _names(value: str) -> set[str]:
    """Class names or ids as whole tokens, with hyphens for underscores."""
    return set(value.lower().replace("_", "-").split())


class _Events(HTMLParser):
    """Lines of a page from its start, end and data events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = [Line()]
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, hidden, article, marks an article itself
        self.links = 0
        self.tags = 0

    def _state(self) -> tuple[bool, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)

    def _new_line(self):
        last = self.lines[-1]
        last.tags += self.tags
        self.tags = 0
        if last.text:
            self.lines.append(Line())

    def handle_starttag(self, tag, attrs):
        hidden, article = self._state()
        if tag == "body" or tag not in HEAD and self.open and self.open[-1][0] == "head":
            self._close_head()
            hidden, article = self._state()
        if tag in BLOCKS:
            # A paragraph, an item or a cell ends where a block begins or the next of its kind does.
            self._close_implied(tag)
            hidden, article = self._state()
            self._new_line()
        self.tags += not hidden
        if tag in VOID:
            if tag == "br" and not hidden:
                self._add(" ")
            return
        marks_article, out = tag in ("article", "main"), tag in HIDDEN
        if attrs and not out:
            a = dict(attrs)
            role, label = (a.get("role") or "").lower(), (a.get("class") or "") + " " + (a.get("id") or "")
            marks_article = marks_article or role in ("main", "article") or bool(_names(label) & ARTICLE_MARKS)
            out = (role in ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true"
                   or bool(_UNSEEN.search(a.get("style") or ""))
                   or not marks_article and tag not in ("html", "body") and bool(_names(label) & MARKS))
        self.links += tag == "a"
        self.open.append((tag, hidden or out, article or marks_article, marks_article))

    def _close_head(self):
        """A head without an end tag ends where the body or any element of it begins."""
        for i, (name, *_) in enumerate(self.open):
            if name == "head":
                self._pop_to(i)
                return

    def _close_implied(self, tag: str):
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ()) + ("p",)
        stop = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ())
        inline_only = True
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in stop:
                return
            if name in ends:
                self._pop_to(i)
                return
            if name in BLOCKS or name in HIDDEN:
                inline_only = False
                if not stop or not inline_only and tag not in ("li", "td", "th", "tr", "dt", "dd"):
                    return

    def _pop_to(self, i: int):
        self.links -= sum(1 for t in self.open[i:] if t[0] == "a")
        del self.open[i:]

    def handle_endtag(self, tag):
        self.tags += not self._state()[0]
        if tag in BLOCKS:
            self._new_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop_to(i)
                return
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag does not close the block around it

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        hidden, _ = self._state()
        if not hidden:
            self._add(data)

    def _add(self, data):
        line = self.lines[-1]
        if not line.text and not data.strip():
            return
        if not line.text:
            line.article = self._state()[1]
        line.text.append(data)
        line.tags += self.tags
        self.tags = 0
        if self.links:
            line.linked += len(data.strip())


def page_lines(html: str) -> list[tuple[str, int, int, bool]]:
    """(text, tags, linked characters, inside a marked article) of each block with text, in page order."""
    events = _Events()
    events.feed(html)
    events.close()
    out = []
    for line in events.lines:
        if text := _SPACE.sub(" ", "".join(line.text)).strip():
            out.append((text, line.tags, line.linked, line.article))
    return out


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the lines; weights are renormed at the ends."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return over(values) / over(np.ones(len(values)))


def two_means_cut(values: np.ndarray) -> float:
    """The middle between the mean of a high cluster, found by iteration from the greatest value, and a low cluster kept at zero:
    a page without anything low is one region, however its lines differ."""
    high = float(values.max())
    for _ in range(50):
        new = float(values[values >= high / 2].mean())
        if new == high:
            break
        high = new
    return high / 2


def line_values(lines: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Logarithms of the ratios of text to tags, with the article mark as a feature."""
    chars, tags, links = (np.array(x, float) for x in ([len(x[0]) for x in lines], [x[1] for x in lines], [x[2] for x in lines]))
    marked = np.array([x[3] for x in lines])
    out = np.log1p(np.where(marked, chars, np.maximum(chars - links, 0)) / np.maximum(tags, 1))
    if marked.any():
        out = np.where(marked, np.maximum(out, out[marked].mean()), UNMARKED * out)
    return out


def main_text(html: str, sigma: float = 1.0, max_linked: float = 0.5) -> str:
    lines = page_lines(html)
    if not lines:
        return ""
    smooth = smoothed(line_values(lines), sigma)
    keep = smooth >= two_means_cut(smooth)
    # Runs of mostly linked lines between two kept lines are inside a region: every other line that is not kept ends it.
    linked = np.array([x[2] > max_linked * len(x[0]) for x in lines])
    ends = np.flatnonzero(keep | ~linked)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if keep[a] and keep[b]:
            keep[a:b] = True
    return "\n".join(x[0] for x, k in zip(lines, keep) if k)


def extract(pages: DataFrame, html: str = "html", sigma: float = 1.0) -> DataFrame:
    """`pages` without the html, with text and n_chars (its code points)."""
    fields = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in fields]
    shape = type(pages.schema)(list(fields)).add("text", "string").add("n_chars", "long")

    def batches(it) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(h.as_py(), sigma) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(html), F.lit("")).alias("_h_html")).mapInArrow(batches, shape)


def op8_html_extraction(spark, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages").select("page_id", "url", "html"))
