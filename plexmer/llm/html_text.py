"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events; every block becomes a line
with its text, its number of tags and its chain of enclosing elements.  The ratio
text / tags of the lines is smoothed with a Gaussian kernel, and lines above a threshold
(a share of the ratios' standard deviation), smoothed and by themselves, form the content clusters (Weninger and Hsu, 2008).
The clusters choose the content regions:

1. lines below a menu, footer or form control are out by their element's name.  Lines below a header, side
   column, form, dialog, or what its role, class or id calls an advert, notice, comment and so on, are out as well, but
   only where that element is a minor block: one that holds nearly all of the clusters' text, with no article or main with
   content elsewhere, is a wrapper whatever its name, and its lines are judged one by one;
2. where most of the clusters' text lies in article or main elements, these are the regions, each whole, as ratios alone would
   cut off headings and short paragraphs;
3. elsewhere the clusters' lines are content; so are lines between them and headings right before them that
   are not mostly links, and paragraphs, headings and items beside them or beside an element around them, but for the page's body.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one line break; nothing else is dropped or capped.

Defined cases: null, empty or tag-only html has an empty text; text without any
element is one block; unclosed elements end with their parent or the page, and so does the silence of an unclosed script-like element; very long pages are one
list of lines, and very deep ones (`DEPTH` levels and more) hang further elements on that level; repeated rows give a row each; a null page_id or url stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

#: Width of the Gaussian kernel, in lines.
SIGMA = 1.0
#: Lines above this share of the ratios' standard deviation are content.
THRESHOLD = 0.5
#: An element with this share of the clusters' text is no minor block.
WRAPPER = 0.9
#: Article and main elements with this share of the clusters' text are the regions.
REGION = 0.5
#: Lines with this share of their text in links are not added to clusters.
LINKS = 0.5
#: Elements are nested this deep at most.
DEPTH = 2000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("nav footer button select textarea menu datalist".split())
_MINOR = frozenset("aside form dialog".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption address".split())
_PAGE = frozenset(("", "html", "body"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS_LI = frozenset("ul ol menu table".split())
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|aside|rail|footer|masthead|topbar|toolbar|ads?|adverts?|advertisement|adsense|banner|promo|sponsor(?:ed)?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|widget|pagination|pager|comments?|commentlist|disqus|repl(?:y|ies)|discussion|feedback)(?:$|[\s_-]|\d)",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_SPACES = re.compile(r"\s+")


class _Element:
    """An open or closed element: whether its lines are never content, whether its name calls it minor, its silence, and the clusters' text below it."""

    __slots__ = ("tag", "parent", "never", "marked", "silent", "region", "depth", "weight")

    def __init__(self, tag: str, parent: _Element | None, never: bool = False, marked: bool = False) -> None:
        self.tag, self.parent, self.marked = tag, parent, marked
        self.never = never or parent is not None and parent.never
        self.silent = tag in _SILENT or parent is not None and parent.silent
        outer = parent.region if parent else None
        self.region = outer or (self if tag in ("article", "main") else None)  # the outermost article or main around
        self.depth = parent.depth + 1 if parent else 0
        self.weight = 0.0  # the clusters' text below


class Line:
    __slots__ = ("text", "tags", "links", "at", "block")

    def __init__(self, text: str, tags: int, links: int, at: _Element) -> None:
        self.text, self.tags, self.links, self.at = text, tags, links, at
        while at.tag in _INLINE and at.parent:
            at = at.parent
        self.block = at

    @property
    def linked(self) -> bool:
        return self.links >= LINKS * len(self.text)


def _above(at: _Element | None) -> Iterator[_Element]:
    while at:
        yield at
        at = at.parent


class Lines(HTMLParser):
    """Lines of a page, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.here = self.root = _Element("", None)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags, self.links = 0, 0

    def _flush(self) -> None:
        if self.text:
            text = _SPACES.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.links, self.here))
                self.tags = 0
            self.text, self.links = [], 0

    def _inside(self, *tags: str) -> bool:
        at = self.here
        while at:
            if at.tag in tags:
                return True
            at = at.parent
        return False

    def _pop(self, tags: set[str], stop: frozenset[str] | tuple = ()) -> None:
        """Close the nearest open element of `tags`, unless one of `stop` is nearer."""
        at = self.here
        while at.parent and at.tag not in tags:
            if at.tag in stop:
                return
            at = at.parent
        if at.parent:
            self._flush()
            self.here = at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br" or tag == "hr":
            self.text.append(" ")
        if tag in _VOID:
            if tag not in _INLINE:
                self._flush()
            return
        if tag not in _INLINE:
            if tag in _CLOSES_P:
                self._pop({"p"}, _KEEPS_LI | {"td", "th", "div", "article", "section", "blockquote", "li"})
            if tag in _SIBLINGS:
                self._pop(_SIBLINGS[tag], _KEEPS_LI)
            self._flush()
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
        never = tag in _NEVER or "hidden" in named or named.get("aria-hidden") == "true"
        marked = tag in _MINOR or tag == "header" and not self._inside("article", "main") or named.get("role", "").lower() in _ROLES
        if not marked and tag not in ("html", "body", "article", "main", *_INLINE):
            marked = bool(_MARKS.search(f"{named.get('class', '')} {named.get('id', '')}"))
        if self.here.depth < DEPTH:
            self.here = _Element(tag, self.here, never, marked)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.here
        while at.parent and at.tag != tag:
            if tag in _INLINE and at.tag not in _INLINE:
                return  # an inline end does not reach over blocks
            at = at.parent
        if not at.parent:
            return
        if tag not in _INLINE:
            self._flush()
        self.here = at.parent

    def handle_data(self, data: str) -> None:
        if not self.here.silent:
            self.text.append(data)
            if self._in_link():
                self.links += len(data)

    def _in_link(self) -> bool:
        at = self.here
        while at.tag in _INLINE:
            if at.tag == "a":
                return True
            at = at.parent
        return False

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def in_clusters(ratios: np.ndarray) -> np.ndarray:
    """Which lines lie above the threshold, smoothed and by themselves."""
    return np.minimum(smoothed(ratios), ratios) >= THRESHOLD * float(ratios.std())


def _marked(at: _Element | None) -> list[_Element]:
    return [e for e in _above(at) if e.marked]


def _minor(line: Line, total: float, articles: set[frozenset[int]]) -> bool:
    """Whether the line is below a minor block: a marked one that is no wrapper of the content, or has an article elsewhere that is below no other marked one."""
    return any(e.weight < WRAPPER * total or any(id(e) not in marks and marks <= {id(x) for x in _marked(e.parent)} for marks in articles) for e in _marked(line.at))


def _weigh(lines: list[Line]) -> float:
    """Add the lines' text to the elements around them; the whole."""
    for line in lines:
        for e in _above(line.at):
            e.weight += len(line.text)
    return float(sum(len(x.text) for x in lines))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    content = in_clusters(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    open_ = [not x.at.never for x in lines]
    total = _weigh([x for x, c, o in zip(lines, content, open_, strict=True) if c and o])
    articles = {frozenset(map(id, _marked(x.at))) for x, o in zip(lines, open_, strict=True) if o and x.at.region}
    open_ = [o and not _minor(x, total, articles) for x, o in zip(lines, open_, strict=True)]
    lines, chosen = [x for x, o in zip(lines, open_, strict=True) if o], [bool(c) for c, o in zip(content, open_, strict=True) if o]
    if not any(chosen):  # none above the threshold is left: what is left is content
        chosen = [True] * len(lines)
    weights = [(len(x.text), x.at.region) for x, c in zip(lines, chosen, strict=True) if c]
    if sum(n for n, r in weights if r) >= REGION * sum(n for n, _ in weights):
        regions = {id(r) for _, r in weights if r}
        return "\n".join(x.text for x in lines if id(x.at.region) in regions)
    return "\n".join(x.text for x, c in zip(lines, grown(lines, chosen), strict=True) if c)


def grown(lines: list[Line], chosen: list[bool]) -> list[bool]:
    """The clusters' lines, those between them and headings right before them that are not mostly links, and paragraphs beside them or elements around them."""
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    while first and lines[first - 1].block.tag in _HEADINGS and not lines[first - 1].linked:
        first -= 1
    beside = {id(x.block.parent) for x, c in zip(lines, chosen, strict=True) if c and x.block.tag in _FLOW}
    beside |= {id(e) for x, c in zip(lines, chosen, strict=True) if c for e in _above(x.block.parent) if e.tag not in _PAGE}
    return [c or not x.linked and (first <= i <= last or x.block.tag in _FLOW and id(x.block.parent) in beside) for i, (x, c) in enumerate(zip(lines, chosen, strict=True))]


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string())], schema=schema)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of `pages` (page_id, url, html)."""
    small_batches(pages.sparkSession, 512)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string")
