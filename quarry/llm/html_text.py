"""HTML main-text extraction by line-block distribution.

Markup is stripped into lines, one per block element.  What can't be article
text (scripts, styles, menus, page headers and footers, asides, forms, adverts,
notices, comments, also in ``article``; by element, role or whole class token)
leaves one empty line, so it separates; block tags in a row don't.  What holds ``main``, the
largest ``article`` or, unless its class is sure, most of the largest stretch is
never hidden, nor is a heading for its id.  Over the lines' text lengths
a sliding window is summed; text surges where the sum leaves zero at a line
with text, and dives where it is back at zero.  A line in ``article`` or
``main`` weighs more; outside these, lines that are mostly links count as
empty.  Stretches whose window sum never reaches ``SURGE`` (or the page's
highest sum, if that is less) are no article's; from the first surge of the
others to their last dive, all text is kept.

Defined results: null or empty html gives the empty text; character references
are decoded once; white space is what ``str.split`` takes for it; an element
that is never closed hides nothing but its own tag; a comment that is never
closed hides the rest; after a tag whose quotes never close, tags end at their
first ``>``; pages of any length are scanned once, in time that grows with
their length; equal pages give equal texts; rows that repeat an id are rows
like others; an empty table gives an empty result; extra columns travel in
the struct ``doc``.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.staging import small_arrow_batches

WINDOW = 3
SURGE, WEIGHT = 40, 4
_NAME = r"<(/?)([A-Za-z][^\s/>]*+)"
#: A comment's head, a declaration, a tag with well-formed quotes, a tag up to the next ``>``.
_TAG = re.compile(rf"<!--|<[!?][^>]*+>|{_NAME}((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|{_NAME}([^>]*+)>")
_PLAIN_TAG = re.compile(rf"<!--|<[!?][^>]*+>|{_NAME}([^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video"}
_APART = {"nav", "footer", "aside", "form", "dialog", "menu"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
_MAIN = {"article", "main"}
_NEVER = {"html", "body", "article", "main", "h1"}
_COMMENT = {"comment", "comments", "comment-body", "comment-content", "comment_body", "comment_content", "reader-comment", "user-comment"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
_SURE = set("ad ads advert adverts advertisement advertising sponsored sponsor cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs comment comments disqus disqus_thread newsletter pagination pager".split())
_WORDS = _SURE | set("promo promotion banner notice popup modal overlay sidebar menu footer header masthead share sharing social related recommended subscribe subscription signup widget toolbar".split())
#: Class tokens of two parts that name such parts of a page; other compounds of the words say where a part is, not what it is.
_COMPOUND = re.compile(
    r"(?P<sure>(?:ad|ads|advert|advertisement|sponsored?)[-_]+(?:banner|block|box|container|inner|label|leaderboard|slot|space|unit|wrap|wrapper|top|bottom|left|right|\d+)|(?:google|banner|top|bottom|side|sidebar|inline|text|display)[-_]+(?:ads?|advert|advertisement)"
    r"|(?:cookie|cookies|consent|gdpr)[-_]+(?:banner|notice|bar|consent|popup|modal|overlay|message)|(?:comment|comments)[-_]+(?:list|area|section|form|thread|respond|wrapper|box|body|content)|(?:reader|user)[-_]+comments?"
    r"|(?:site|page|main|top|primary|secondary|footer|mobile)[-_]+(?:nav|navbar|navigation|breadcrumbs?)|(?:nav|navbar)[-_]+(?:bar|menu|links|list|items?)|breadcrumbs?[-_]+(?:list|nav|trail|items?)|pagination[-_]+(?:links|nav)|newsletter[-_]+(?:form|box|signup|banner|popup|modal))"
    r"|(?:site|page|main|global)[-_]+(?:footer|header|masthead)|(?:site|page|left|right|primary|secondary|main|top|mobile)[-_]+(?:sidebar|menu|banner|toolbar)|sidebar[-_]+(?:left|right|primary|secondary|widget)|(?:footer|header)[-_]+(?:nav|links|menu|widgets)"
    r"|(?:share|sharing|social)[-_]+(?:buttons|bar|links|icons|media|share|tools)|(?:related|recommended)[-_]+(?:posts|articles|links|stories|content|items|news)|(?:subscribe|subscription|signup)[-_]+(?:form|box|banner|popup|modal)|menu[-_]+(?:bar|list|items?)|(?:modal|popup)[-_]+(?:dialog|overlay|backdrop)"
)
_HEADS = {"header", "masthead", "page-header", "main-header", "page_header", "main_header"}
_NO_CLASS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _word(token: str) -> int:
    """2 for a word that can't name what wraps the article, 1 for one that can, 0 for none."""
    if token in _WORDS:
        return 2 if token in _SURE else 1
    m = _COMPOUND.fullmatch(token)
    return 0 if m is None else 2 if m["sure"] else 1


def _apart(name: str, attributes: str, in_main: bool) -> int:
    """2: no article text by what it is; 1: only if it doesn't hold the largest stretch; 0: text."""
    if name in _APART or (name == "header" and not in_main):
        return 1 if name == "form" else 2
    found = [(key.lower(), next((v for v in values if v), "").lower()) for key, *values in _ATTRIBUTE.findall(attributes)] if attributes.strip() else []
    if name == "article":
        return 2 * any(key == "class" and not _COMMENT.isdisjoint(value.split()) for key, value in found)
    if name in _NEVER:
        return 0
    sure, slug = 0, name in _NO_CLASS or (in_main and (name == "section" or any(key == "class" and "section" in value.split() for key, value in found)))
    for key, value in found:
        if key == "hidden" or (key == "aria-hidden" and value == "true" and name not in _INLINE) or (key == "role" and value in _ROLES):
            sure = max(sure, 1)
        elif key == "class" or (key == "id" and not slug):
            sure = max([sure, *(_word(t) for t in value.split() if not (in_main and t in _HEADS))])
    return sure


class _Page:
    """A page's tags (start, end, name, closing, attributes), where each element ends, and what no hidden element may hold."""

    def __init__(self, page: str) -> None:
        self.text, self.tags, self.ends = page, [], {}
        low = page.lower()
        if len(low) != len(page):  # a letter whose lower case is longer; offsets must agree
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
        at, opened, last, tag = 0, {}, page.rfind(">") + 1, _TAG
        endless: set[str] = set()
        while at < last and (m := tag.search(page, at, last)):
            start, at = m.start(), m.end()
            if m[0] == "<!--":
                done = _COMMENT_END.search(page, at)
                at = done.end() if done else len(page)
                self.tags.append((start, at, "", False, ""))
                continue
            if tag is _TAG and m[5]:  # quotes that never close: from here on every tag ends at its first >
                tag, closing, name, attributes = _PLAIN_TAG, bool(m[4]), m[5], m[6]
            else:
                closing, name, attributes = bool(m[1]), m[2] or "", m[3] or ""
            name, k = name.lower(), len(self.tags)
            if name in _RAW and not closing and name not in endless:
                if (end := low.find(f"</{name}", at)) >= 0:
                    at = end
                else:
                    endless.add(name)
            self.tags.append((start, at, name, closing, attributes))
            stack = opened.setdefault(name, [])
            if closing and stack:
                self.ends[stack.pop()] = k
            elif not closing and name and name not in _VOID and name not in _RAW and not attributes.rstrip().endswith("/"):
                if name == "p" and stack:  # a paragraph ends where the next begins
                    self.ends[stack.pop()] = k - 1
                stack.append(k)
        if at < len(page) and (start := page.find("<!--", max(at, last))) >= 0:
            self.tags.append((start, len(page), "", False, ""))
        self.heads = [k for k, t in enumerate(self.tags) if t[2] == "h1" and not t[3]]
        own = [k for k in self.ends if self.tags[k][2] == "article" and not self.comment(k)]
        largest = max(own, key=lambda k: (self.tags[self.ends[k]][0] - self.tags[k][1], -k), default=None)
        self.core = sorted(k for k in self.ends if self.tags[k][2] == "main" or k == largest)

    def holds(self, k: int, inner: list[int]) -> bool:
        """Whether one of the tags ``inner`` (in page order) lies inside element k."""
        first = bisect_right(inner, k)
        return first < len(inner) and inner[first] <= self.ends[k]

    def comment(self, k: int) -> bool:
        """A reader's comment: an article by class, without a title of its own."""
        return bool(_apart("article", self.tags[k][4], True)) and not self.holds(k, self.heads)

    def hides(self, k: int, in_main: bool) -> int:
        """As _apart, but 0 for what is never closed or holds the article."""
        name, attributes = self.tags[k][2], self.tags[k][4]
        if k not in self.ends or not (sure := _apart(name, attributes, in_main)):
            return 0
        if name == "article":
            return 2 * (self.comment(k) and not self.holds(k, self.core))
        return 0 if self.holds(k, self.core) or (in_main and name not in _APART and self.holds(k, self.heads)) else sure

    def lines(self, shown: set[int] | None = None) -> tuple[list[tuple[str, int, bool]], list[int], list[int]]:
        """Lines, the tag each ends at, and the doubtful elements; these are all shown, or else the ``shown`` ones."""
        lines: list[tuple[str, int, bool]] = []
        ends: list[int] = []
        doubtful: list[int] = []
        parts: list[str] = []
        linked, inside, links, k, at = 0, 0, 0, 0, 0

        def close(apart: bool = False) -> None:
            nonlocal parts, linked
            text = " ".join(_html.unescape("".join(parts)).split())
            if text or apart:  # block tags in a row make no line of their own
                lines.append((text, linked, inside > 0))
                ends.append(k)
            parts, linked = [], 0

        def say(text: str) -> None:
            nonlocal linked
            if text:
                parts.append(text)
                if links:
                    linked += len(text.strip())

        while k < len(self.tags):
            start, end, name, closing, _ = self.tags[k]
            say(self.text[at:start])
            at = end
            if name and name not in _RAW:
                if name not in _INLINE:
                    close()
                sure = 0 if closing or name in _VOID else self.hides(k, inside > 0)
                if sure == 1:
                    doubtful.append(k)
                    sure = 0 if shown is None or k in shown else 2
                if sure:
                    close()
                    close(apart=True)
                    k = self.ends[k]
                    at = self.tags[k][1]
                elif name in _MAIN:
                    inside = max(0, inside + (-1 if closing else 1))
                elif name == "a":
                    links = 0 if closing else 1
            k += 1
        say(self.text[at:])
        close()
        return lines, ends, doubtful


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters of link text, inside article or main) per line; each stripped part gives one empty line."""
    parsed = _Page(page)
    lines, ends, doubtful = parsed.lines()
    if not doubtful:
        return lines
    lengths = [weight(*line) for line in lines]
    a, b = max(stretches(lengths), key=lambda r: sum(lengths[r[0] : r[1]]), default=(0, 0))
    before = [0, *accumulate(lengths)]
    within = lambda k: before[bisect_right(ends, parsed.ends[k], a, b)] - before[bisect_right(ends, k, a, b)]
    shown = {k for k in doubtful if 2 * within(k) > before[b] - before[a]}
    return parsed.lines(shown)[0]


def stretches(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) line ranges: from a line with text on until the window's sum is zero."""
    out, at, n = [], 0, len(lengths)
    while at < n:
        if not lengths[at]:
            at += 1
            continue
        to, ahead = at, sum(lengths[at : at + window])
        while to < n and ahead:
            ahead += (lengths[to + window] if to + window < n else 0) - lengths[to]
            to += 1
        out.append((at, to))
        at = to
    return out


def article(lengths: list[int], window: int = WINDOW) -> tuple[int, int]:
    """Lines from the first surge to the last dive."""
    found = stretches(lengths, window)
    peaks = [max(sum(lengths[k : k + window]) for k in range(a, b)) for a, b in found]
    least = min(SURGE, max(peaks, default=0))
    high = [r for r, peak in zip(found, peaks) if peak >= least]
    return (high[0][0], high[-1][1]) if high else (0, 0)


def weight(text: str, linked: int, inside: bool) -> int:
    """A line's length for the windows: any text in article or main surges, mostly links elsewhere count as none."""
    if inside and text:
        return max(SURGE, WEIGHT * len(text))
    return 0 if 2 * linked > len(text) else len(text)


def main_text(page: str | None) -> str:
    lines = page_lines(page or "")
    a, b = article([weight(*line) for line in lines])
    return " ".join(text for text, *_ in lines[a:b] if text)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """(doc struct of ``keep`` or all columns, text) for every row of ``pages``."""
    small_arrow_batches(pages.sparkSession)
    packed = pages.select(F.struct(*[pages[c] for c in (pages.columns if keep is None else keep)]).alias("doc"), pages[html].cast("string").alias("_html"))
    return packed.mapInArrow(_extract, T.StructType([packed.schema["doc"], T.StructField("text", T.StringType())]))
