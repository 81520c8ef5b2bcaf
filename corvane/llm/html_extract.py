"""Main text of web pages, from streaming parser events.

The standard library's parser turns a page into lines, one a block element, each
with its text length, its count of tags, how much of it is link text, and the
region it lies in. Regions that are never main text (navigation, headers outside
the article, footers, asides, forms, scripts, adverts, notices, comments) are
known by element, role, class or id. On every page the text-to-tag ratios of the
lines are smoothed by a Gaussian, and lines above a threshold between the two
clusters of smoothed ratios (two means) are content, with headings next to them.
An article or main element is a prior on its lines: they are content unless most
of their text is links and their ratio is below the threshold.

Nulls and empty pages: empty text. A line's text is never cut. White space in a block is
one space; blocks are joined by a blank line, in page order. Repeated rows are
kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, trim

#: HTML's element names by their part in a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea option iframe object svg canvas audio video dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of a class or id that mark a region beside the main text.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer|foot|masthead|topbar|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|share|sharing|social\w*|related|recommend\w*|comments?|disqus|respond|repl(?:y|ies)|pagination|pager|toolbar|skip\w*|copyright|legal|hidden)(?:$|[\s_-])",
    re.I,
)
_SPACE = re.compile(r"\s+")
_TAIL = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?\Z")
#: An open element of these is closed by the next of the same kind (or, for p, by any block).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # element, beside the main text, article number
        self.lines: list[list] = []  # text parts, tags, link characters, article, heading
        self.articles = 0
        self.line: list | None = None
        self.open: Counter[str] = Counter()  # elements on the stack, by name

    def _open(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def _new_line(self) -> None:
        self.line = None

    def handle_starttag(self, tag, attrs):
        beside, article = self._open()
        if tag in BLOCK:
            self._close("p")
            for t in _CLOSES.get(tag, ()):
                if self.stack and self.stack[-1][0] == t:
                    self._close(t)
            beside, article = self._open()
            self._new_line()
        elif self.line is not None:
            self.line[1] += 1
        if tag in VOID:
            self.handle_data(" ")
            return
        if tag in ("article", "main") and not beside and not article:
            self.articles += 1
            article = self.articles
        if not beside:
            named = {k: v or "" for k, v in attrs}
            marks = f"{named.get('class', '')} {named.get('id', '')}"
            beside = tag in NEVER or tag == "header" and not article or named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden") == "true"
            beside = beside or tag not in ("html", "body", "article", "main") and bool(BESIDE.search(marks))
        self.stack.append((tag, beside, article))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all in it; nothing, where none is open."""
        while self.open[tag]:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == tag:
                break

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._new_line()
        elif self.line is not None:
            self.line[1] += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        beside, article = self._open()
        if beside:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = [[], 1, 0, article, any(self.open[h] for h in HEADINGS)]
            self.lines.append(self.line)
        self.line[0].append(data)
        if self.open["a"]:
            self.line[2] += len(data)


def _content(lines: list[tuple[str, int, int, int, bool]], sigma: float) -> list[bool]:
    """Which lines are content, by smoothed text-to-tag ratio and the marks of the page."""
    ratio = np.array([max(0, len(t) - links) / (tags + 1) for t, tags, links, _, _ in lines])
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    padded = np.pad(ratio, 2, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), "valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(20):
        near_high = abs(smooth - high) < abs(smooth - low)
        if near_high.all() or not near_high.any():
            break
        low, high = smooth[~near_high].mean(), smooth[near_high].mean()
    marked = np.array([article > 0 for *_, article, _ in lines])
    if high < 2 * max(low, 8.0):  # one cluster: nothing here is set apart, but by marks
        if marked.all() or not marked.any():
            return [True] * len(lines)
        threshold = min((low + high) / 2, ratio[marked].mean())
    else:
        threshold = (low + high) / 2 if low > 0 else high / 4
    own = np.array([2 * links <= len(t) for t, _, links, _, _ in lines])
    keep = (smooth >= threshold) | (ratio >= threshold) | (marked & own)
    return [bool(k or h and keep[i + 1 : i + 2].any()) for i, (k, (*_, h)) in enumerate(zip(keep, lines, strict=True))]


def extract_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(_TAIL.sub("", html))
    parser.close()
    lines = [(text, *rest) for parts, *rest in parser.lines if (text := _SPACE.sub(" ", "".join(parts)).strip())]
    if not lines:
        return ""
    return "\n\n".join(line[0] for line, keep in zip(lines, _content(lines, sigma), strict=True) if keep)


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``'s columns (those named ``text`` or ``n_chars`` are replaced), the ``text`` and ``n_chars`` of each page."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    columns = pages.select(*keep, F.col(html).alias(free_name(pages, "source")))

    def extract(batches):
        for b in batches:
            texts = [extract_text(h) for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])
        trim()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns.schema[:-1])
    return columns.mapInArrow(extract, f"{fields}text string, n_chars long")
