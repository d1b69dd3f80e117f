"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, without those of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, and each line gets an effective length: its
characters outside links, or zero where links are half of it. Effective lengths are summed over sliding
windows of lines. The text surges where a window's sum rises above a threshold and dives where it falls
back. The lines from the first surge to the last dive are the text, short ones and lists between spans
included. An ``article`` or ``main`` with a surging line is verified: all its lines are text. On a page
without a surge all lines are, but for mostly linked ones outside ``article`` and ``main``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
FALLBACK = frozenset("noscript template object audio video canvas".split())
OUTSIDE = frozenset("nav header footer aside menu dialog button select datalist search".split()) | FALLBACK
UNSEEN = frozenset("desc metadata defs annotation annotation-xml".split())  # in svg and math
SCOPES = ("article", "main")
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
CELLS = frozenset("table caption td th template object button".split())  # an end tag reaches no further out
KEPT = frozenset("a td th svg math".split())  # besides blocks
# Elements whose end tag may be left out; the next of the group ends one, unless a barrier is nearer.
IMPLIED = (
    (("li",), frozenset("ul ol menu dir".split())),
    (("dt", "dd"), frozenset(("dl",))),
    (("option",), frozenset(("select", "datalist", "optgroup"))),
    (("optgroup",), frozenset(("select",))),
    (("td", "th"), frozenset(("tr", "table"))),
    (("tr",), frozenset(("table",))),
    (("thead", "tbody", "tfoot"), frozenset(("table",))),
)
DEEPEST = 512  # open elements; deeper ones hide nothing
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup popover promo promoted promotion related replies respond search share sharing sidebar signup sitenav skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
COMMENTS = frozenset("comment comments disqus replies respond".split())
# Words that say where a marked element stands; a token of other words besides marks is no mark.
PLACES = frozenset("site main top bottom left right primary secondary global page".split())

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    scope: int  # the number of the outermost article or main around it, or 0
    mark: int = -1  # the innermost marked element around it

    @property
    def length(self) -> int:
        return len(self.text) - self.linked if self.linked * 2 < len(self.text) else 0


@dataclass
class Mark:
    parent: int
    comment: bool
    weight: int = 0
    count: int = 0


def _marked(name: str, attributes: str) -> str:
    """Why an element is marked as not the article: ``comment``, another reason, or nothing."""
    if name == "form":
        return "form"
    if name in ("body", "html", "main") or not attributes:
        return ""
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            found = _WORD.findall(token)
            if not MARKS.isdisjoint(found) and (MARKS | PLACES).issuperset(found):
                return "comment" if not COMMENTS.isdisjoint(found) else "word"
    return "hidden" if _HIDDEN.search(attributes) else ""


class _Page:
    """Reads a page's tags in order; closing an element closes those left open inside it, as browsers do."""

    def __init__(self) -> None:
        self.out: list[Line] = []
        self.marks: list[Mark] = []
        self.text: list[str] = []
        self.stack: list[tuple[str, str]] = []  # name, and what its end undoes: "", "hide" or "mark"
        self.open: Counter[str] = Counter()
        self.linked = self.hidden = self.scope = self.scopes = 0
        self.mark = -1

    def end(self) -> None:
        if self.text:
            found = " ".join(unescape("".join(self.text)).split())
            if found:
                self.out.append(Line(found, min(self.linked, len(found)), self.scope, self.mark))
            self.text.clear()
        self.linked = 0

    def add(self, piece: str) -> None:
        if not self.hidden:
            self.text.append(piece)
            if self.open["a"]:
                self.linked += len(piece)

    def push(self, name: str, kind: str) -> None:
        if len(self.stack) >= DEEPEST:
            return
        if kind == "hide":
            self.hidden += 1
        if name in SCOPES and not self.scope:
            self.scopes += 1
            self.scope = self.scopes
        self.stack.append((name, kind))
        self.open[name] += 1

    def close(self, names: tuple[str, ...], barriers: frozenset[str]) -> None:
        """Close the innermost open element of ``names`` and all inside it, unless a barrier is nearer."""
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in barriers:
                return

    def pop(self) -> None:
        name, kind = self.stack.pop()
        if kind == "mark":
            self.end()
            self.mark = self.marks[self.mark].parent
        self.hidden -= kind == "hide"
        self.open[name] -= 1
        if name in SCOPES and not any(self.open[n] for n in SCOPES):
            self.end()
            self.scope = 0

    def start(self, name: str, attributes: str) -> None:
        empty = attributes.rstrip().endswith("/")
        foreign = self.open["svg"] or self.open["math"]
        if name in BLOCKS and name not in ("option", "optgroup"):
            self.close(("p",), CELLS)
        for group, barriers in IMPLIED:
            if name in group:
                self.close(group, barriers)
        if name in BLOCKS:
            self.end()
        elif name in ("br", "td", "th"):
            self.add(" ")
        if name == "a":
            self.close(("a",), BLOCKS | CELLS)
        if name in VOID or (empty and (foreign or name in ("svg", "math"))):
            return
        kind = "hide" if name in OUTSIDE or (foreign and name in UNSEEN) else "mark" if (why := _marked(name, attributes)) else ""
        if kind and empty and name != "a":
            return
        if kind == "mark":
            self.end()
            self.marks.append(Mark(self.mark, why == "comment"))
        elif kind and name not in FALLBACK | UNSEEN:
            self.end()
        elif kind:
            self.add(" ")
        before = len(self.stack)
        if kind or self.hidden or self.mark >= 0 or name in BLOCKS or name in KEPT:
            self.push(name, kind)
        if kind == "mark":
            if len(self.stack) > before:
                self.mark = len(self.marks) - 1
            else:
                self.marks.pop()

    def read(self, html: str) -> None:
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self.add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if name in BLOCKS:
                    self.end()
                elif name in ("td", "th"):
                    self.add(" ")
                if name in ("body", "html"):
                    while self.stack:
                        self.pop()
                else:
                    self.close((name,), frozenset(("table",)) if name in TABLE else CELLS)
            elif name in RAW and not ((self.open["svg"] or self.open["math"]) and m[3].rstrip().endswith("/")):
                stop = _ENDS[name].search(html, at)
                if name == "xmp":
                    self.end()
                    self.add(html[at : stop.start() if stop else len(html)].replace("&", "&amp;"))
                    self.end()
                elif name == "title" and not self.open["svg"]:
                    self.end()
                else:
                    self.add(" ")
                if stop:
                    at = stop.end()
                elif name in ("script", "style", "xmp"):
                    at = len(html)
            else:
                self.start(name, m[3])
        self.add(html[at:])
        self.end()


def lines(html: str, threshold: int = 86) -> list[Line]:
    """The page's visible lines outside menus and the like; white space is one space, references are decoded.

    Marked elements are left out, but for those that hold more than half of the page's unlinked characters:
    such a wrapper is the text, whatever its class says. Reader comments are only if nothing else is, and beside an
    unmarked article only what could surge and has several lines is a wrapper, which a long advert isn't.
    """
    page = _Page()
    page.read(html)
    for line in page.out:
        k = line.mark
        while k >= 0:
            page.marks[k].weight += line.length
            page.marks[k].count += line.length > 0
            k = page.marks[k].parent
    total = sum(line.length for line in page.out)
    article = any(line.scope and line.length and line.mark < 0 for line in page.out)
    shown = []
    for mark in page.marks:  # parents come before what they hold
        bulk = mark.weight * 2 > total and (not mark.comment or total - mark.weight <= threshold)
        bulk = bulk and (not article or (mark.count > 1 and mark.weight > threshold))
        shown.append(bulk and (mark.parent < 0 or shown[mark.parent]))
    return [line for line in page.out if line.mark < 0 or shown[line.mark]]


def surges(lengths: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """Spans [surge, dive) of lines whose windows of ``window`` lines sum to over ``threshold``."""
    n, spans, begin = len(lengths), [], -1
    total = sum(lengths[:window])
    for i in range(n + 1):
        above = i < n and total > threshold
        if above and begin < 0:
            begin = i
        elif not above and begin >= 0:
            spans.append((begin, min(n, i - 1 + window)))
            begin = -1
        if i < n:
            total += (lengths[i + window] if i + window < n else 0) - lengths[i]
    return spans


def main_text(html: str | None, window: int = 3, threshold: int = 86) -> str:
    """The article's lines joined by ``\\n``; empty for a null, empty or textless page."""
    found = lines(html or "", threshold)
    lengths = [line.length for line in found]
    spans = surges(lengths, window, threshold)
    if not spans:
        return "\n".join(line.text for line in found if line.length or line.scope)
    surging = {line.scope for a, b in spans for line in found[a:b] if line.scope and line.length}
    begin, stop = spans[0][0], spans[-1][1]
    while begin < stop and not lengths[begin]:
        begin += 1
    while stop > begin and not lengths[stop - 1]:
        stop -= 1
    return "\n".join(line.text for i, line in enumerate(found) if begin <= i < stop or line.scope in surging)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = 3, threshold: int = 86) -> DataFrame:
    """``keep`` columns, text and n_chars (code points), one row per row of ``df``, without a shuffle.

    A null html counts as empty and gives an empty text; nulls in ``keep`` pass through; an empty table
    gives no rows; repeated rows give repeated rows; other columns are dropped, whatever their names.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("_html"))
    schema = kept.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, window, threshold) for h in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return kept.mapInArrow(run, schema)
