"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block; every block boundary ends a line.
Elements that are boilerplate by their kind (scripts, navigation, asides, forms, footers,
adverts, notices, reader comments and the like, told by tag, role or a container's class words)
leave an empty line in their place, as does any run of container edges: one, however deep they
nest, so that layout alone never parts an article. Lists of links leave a window of empty lines.

Text lengths, without links, are summed over every window of WINDOW lines. A surge is where the
sums rise to a threshold, a dive where they fall below it again: ENOUGH characters, or
half of the largest sum on a page that has no such window. A line belongs to the
stretch between a surge and a dive if any window over it reaches the threshold, so short lines
beside text stay. The article is all that lies between the first surge and the last dive, with
the rest of the container that holds most of the text there: what a page has before, after or
beside that and has no dense text of its own is no article. Where a page marks articles or a
main part, the lines outside are empty and any line inside reaches the threshold.

Defined results: a null or empty page has an empty text and 0 characters; an unclosed
element ends with its container or the page; a stray "<" is text; white space inside a block
becomes one space; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import in_slices, utf8

#: Lines in a window. The edge of the body and a list of links count as so many empty lines; a list has at least so many links.
WINDOW = 3

#: Characters outside links that a window of dense text has.
ENOUGH = 100

# Element names of HTML by their part in a page, and words in class or id that mark boilerplate.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title"}
BOILERPLATE = {"nav", "aside", "footer", "header", "form", "button", "menu", "dialog", "head", "audio", "video", "map"}
CONTAINERS = {"article", "main", "section", "div", "body", "html", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "figure", "figcaption", "blockquote", "details", "fieldset"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "br", "address", "caption", "summary", "legend", "center", "option", "hgroup", "search"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "related", "recommended",
    "header", "masthead", "footer", "copyright", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "comment", "comments",
    "disqus", "reply", "replies", "pagination", "pager", "tags", "toolbar", "skip",
}

#: Words that mark boilerplate only where no word of ARTICLE stands beside them: an article's own header is its title.
SOFT = {"header", "notice", "promotion", "tags", "related", "banner", "toolbar", "search"}
ARTICLE = {"article", "post", "entry", "story", "content", "main", "page", "text", "body", "blog", "news"}
#: Elements whose class words count: parts of a layout, not the text's own blocks.
LAYOUT = {"div", "section", "ul", "ol", "dl", "table", "tr", "td", "figure", "details", "fieldset", "center", "li", "blockquote"}

_START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_BLANKS = re.compile(r"\s+")


def _marks(token: str) -> bool:
    """Whether a class or id says boilerplate."""
    words = {x.lower() for x in _PARTS.findall(token)}
    return bool(words & (MARKS - SOFT)) or bool(words & SOFT) and not words & (ARTICLE - {"page"} if "header" in words else ARTICLE)


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILERPLATE:
        return not (tag == "header" and in_article)
    if not attrs.strip() or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and tag in LAYOUT and any(_marks(token) for token in value.split()):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs)) or "display:none" in attrs.replace(" ", "")


class Line(NamedTuple):
    """inside: an article or main part. owner: number of the innermost container, which is above those of all inside it. linked, links: characters in links, and their number."""

    text: str
    inside: bool
    owner: int
    linked: int
    links: int


_GAP = Line("", False, -1, 0, 0)


def _edge(tag: str) -> int:
    """Empty lines at a container's edge; a run of single ones is one."""
    return WINDOW if tag == "body" else 1 if tag in ("article", "main", "div", "section", "table") or tag in BOILERPLATE else 0


class Token(NamedTuple):
    """A piece of markup. tag is None for comments and declarations."""

    start: int
    end: int
    closing: bool
    tag: str | None
    attrs: str


class Markup:
    """The markup of a page, in order. Every place is looked at a bounded number of times, however broken quotes and tags are.

    A tag ends at the first ">" outside quotes; where there is none, or a quote stays open, its "<" is text. Places
    that were once followed to their end, and things that were once found missing, are remembered.
    """

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()  # what doesn't occur after a place that was reached
        self.ends: dict[int, int] = {}  # of sequences outside quotes that go on at a sign; -1: they never end
        self.from_, self.sign = 0, -2  # no sign lies between the first place and the second

    def after(self, what: str, at: int) -> int:
        """The place of `what` at or after a place, or -1."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _next_sign(self, at: int) -> int:
        """The next of the signs that matter inside a tag, or -1."""
        if self.from_ <= at <= self.sign or self.sign == -1 and self.from_ <= at:
            return self.sign
        found = _SIGN.search(self.page, at)
        self.from_, self.sign = at, found.start() if found else -1
        return self.sign

    def tag_end(self, at: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin at a place, or -1."""
        seen, sign = [], self._next_sign(at)
        end = None
        while end is None:
            if sign < 0:
                end = -1
            elif sign in self.ends:
                end = self.ends[sign]
            elif self.page[sign] == ">":
                end = sign
            else:
                seen.append(sign)
                close = self._closing(sign)
                if close < 0:
                    end = -1
                else:
                    found = _SIGN.search(self.page, close + 1)
                    sign = found.start() if found else -1
        for place in seen:
            self.ends[place] = end
        return end

    def _closing(self, quote: int) -> int:
        """The place of the quote that closes a quote, or -1."""
        return self.page.find(self.page[quote], quote + 1)

    def search(self, at: int) -> Token | None:
        """The first token at or after a place."""
        while (m := _START.search(self.page, at)) is not None:
            text = m[0]
            if text in ("<!--", "<![CDATA["):
                mark = "-->" if text == "<!--" else "]]>"
                end = self.after(mark, m.end())
                return Token(m.start(), len(self.page) if end < 0 else end + 3, False, None, "")
            end = self.after(">", m.end()) if m[2] is None else self.tag_end(m.end())
            if end >= 0:
                return Token(m.start(), end + 1, bool(m[1]), m[2], self.page[m.end() : end] if m[2] else "")
            at = m.start() + 1
        return None


_SIGN = re.compile("[>\"']")


def lines(page: str) -> tuple[list[Line], list[int]]:
    """The lines of the stripped page, where empty lines part containers, and the container around each container."""
    out: list[Line] = []
    around = [-1]
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # open containers: tag, whether its content is dropped
    owners = [0]  # numbers of the page and of the open containers
    dropped, marked, at, n = 0, 0, 0, len(page)
    link: int | None = None  # open containers where the open link began
    linked, links, opened = 0, 0, 0

    def end_line(edge: int = 0) -> None:
        nonlocal linked, links
        if text:
            line = _BLANKS.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append(Line(line, marked > 0, owners[-1], min(linked, len(line)), links))
            linked, links = 0, 0
        if edge and not marked and (edge > 1 or out and out[-1].text):
            out.extend([_GAP] * edge)

    def close(depth: int) -> None:
        nonlocal dropped, marked, link
        if link is not None and depth < link:
            link = None
        while len(stack) > depth:
            tag, drops = stack.pop()
            is_open[tag] -= 1
            owners.pop()
            dropped -= drops
            marked -= tag in ("article", "main")

    markup, unended = Markup(page), set()
    is_open: Counter[str] = Counter()
    while at < n:
        m = markup.search(at)
        if m is None:
            if not dropped:
                text.append(page[at:])
            break
        if not dropped and m.start > at:
            text.append(page[at : m.start])
            if link is not None:
                linked += len(html.unescape(text[-1]).strip())
        at = m.end
        if m.tag is None:
            continue
        tag, closing, attrs = m.tag.lower(), m.closing, m.attrs
        if not closing and tag in RAW:
            end = None if tag in unended else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                unended.add(tag)
            if not attrs.rstrip().endswith("/"):
                at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if not closing and (tag in BLOCKS or tag in CONTAINERS) and tag != "br" and stack and stack[-1][0] in ("p", "li", "dt", "dd"):
            close(len(stack) - 1)  # a dropped paragraph or item ends where the next block begins
        if tag == "a":
            link = None
            if not closing and not dropped and "href" in attrs.lower():
                link = len(stack)
                links += 1
        if tag in CONTAINERS or tag in BOILERPLATE or not closing and tag not in VOID and "=" in attrs and _boilerplate(tag, attrs, marked > 0):
            if closing:
                if is_open[tag]:
                    depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                    end_line()
                    close(depth)
                    end_line(_edge(tag))
            elif not attrs.endswith("/"):
                if tag in ("body", "main"):  # neither is ever inside boilerplate that was left open
                    text.clear() if dropped else end_line()
                    close(next(i for i, (_, drops) in enumerate(stack) if drops) if dropped else len(stack))
                end_line(_edge(tag))
                drops = _boilerplate(tag, attrs, marked > 0)
                stack.append((tag, drops))
                is_open[tag] += 1
                opened += 1
                around.append(owners[-1])
                owners.append(opened)
                dropped += drops
                marked += tag in ("article", "main")
        elif closing and is_open[tag]:  # a dropped inline or block element
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
            close(depth)
        elif tag in BLOCKS:
            end_line()
    end_line()
    return out, around


def stretches(sizes: np.ndarray, threshold: int = 1, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) pairs: the runs of lines over which some window sum of text lengths reaches the threshold, without empty edges."""
    if not len(sizes):
        return []
    sums = np.convolve(sizes, np.ones(window, np.int64))  # each of the windows that hold a line, cut at the page's ends
    reached = np.convolve((sums >= threshold).astype(np.int64), np.ones(window, np.int64))[window - 1 : window - 1 + len(sizes)] > 0
    edges = np.diff(np.concatenate([[0], reached.astype(np.int8), [0]]))
    out = []
    for surge, dive in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        filled = np.flatnonzero(sizes[surge:dive])
        out.append((surge + int(filled[0]), surge + int(filled[-1]) + 1))
    return out


def _parted(own: list[Line]) -> list[Line]:
    """The lines with a window of empty ones for each list of links: a run of lines with WINDOW links or more that have over half of its text."""
    out: list[Line] = []
    for blank, run in groupby(own, lambda x: not x.text):
        block = list(run)
        many = not blank and sum(x.links for x in block) >= WINDOW and 2 * sum(x.linked for x in block) > sum(len(x.text) for x in block)
        out += [_GAP] * WINDOW if many else block
    return out


def main_text(page: str) -> str:
    """The article's blocks, joined by line breaks."""
    own, around = lines(page)
    if any(x.inside for x in own):
        own = [x if x.inside else _GAP for x in own]
        weights = np.array([ENOUGH if x.text else 0 for x in own], np.int64)
    else:
        parted = _parted(own)
        own = parted if any(x.text for x in parted) else own  # a page of links only
        weights = np.array([len(x.text) - x.linked for x in own], np.int64)
        if not weights.any():
            weights = np.array([len(x.text) for x in own], np.int64)
    if not weights.any():
        return ""
    most = int(np.convolve(weights, np.ones(WINDOW, np.int64)).max())
    found = stretches(weights, min(ENOUGH, -(-most // 2)))
    # The container with most of the text of the fullest stretch; what it holds before the first surge and after the last dive is the article's too.
    surge, dive = max(found, key=lambda x: (int(weights[x[0] : x[1]].sum()), -x[0]))
    text: Counter[int] = Counter()
    for x, w in zip(own[surge:dive], weights[surge:dive].tolist(), strict=True):
        text[x.owner] += w
    home = max(text, key=lambda c: (text[c], -c))
    within = {home}
    for c in range(home + 1, len(around)):
        if around[c] in within:
            within.add(c)
    first, last = found[0][0], found[-1][1]
    return "\n".join(x.text for i, x in enumerate(own) if x.text and (first <= i < last or x.owner in within))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 2):
        texts = [main_text((b or b"").decode("utf-8")) for b in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page; one pass, no shuffle."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("body"))
    return rows.mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")
