"""Main text of web pages (operator 10).

Events of the standard library's streaming parser become lines, one for each block element: its text, the
number of tags in it, and where it stands. Lines in menus, headers and footers of the page, sidebars, notices,
adverts, forms, comments and hidden elements count as no text. Forms and names in classes and ids mark such a part
if a whole name does (`related-posts`, not `has-related`), or if it ends in comments (`user-comments`); headings and
quotations are never one, nor is what holds nearly all text or, in a page without another article or main element, an
article that holds most of it and what encloses one. Were all text dropped by marks, marks do not count.

The text-to-tag ratios are smoothed by a Gaussian and lines above a threshold (the deviation of the smoothed ratios)
form clusters. The clusters choose the content regions: the outermost article and main elements that hold lines of
clusters or, in a page without such an element, the lowest element that holds all of those lines. All lines of
these regions stay, short ones too, in page order. If they don't begin with a heading, the last title (h1) before them and what
stands between (a lead, say) belong to them.

The parser is fed text and whole tags one by one. Where a tag ends is found in one sweep (`cut`): comments, declarations,
and the contents of scripts and their like are left out there, a tag that never ends goes, what the parser can't take is skipped. Elements
know their parent by number, so time and memory grow with the page alone, however deep or broken it is.

A null or empty page gives an empty text and an empty table an empty one; broken markup is read as far as it goes;
urls may be null; rows repeat as they come. Columns other than the id and `keep` are not carried over, whatever
their names. Memory is bounded by one slice of pages and one page's lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import map_slices

SIGMA = 1.0

# Element names of HTML, and words that name parts of a page in classes and ids.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
BOXES = set("body center div section td".split())
DROPPED = set("aside audio button canvas dialog footer head iframe input menu nav noscript object option script search select style svg template textarea title video".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted banner sidebar menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer foot masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup login widget widgets toolbar pagination pager search skip".split()
)
#: Neutral words that stand beside them in names of one part of a page.
BESIDE = set("box block area container wrap wrapper list item items link links section bar post posts article articles story stories content button buttons form header title text top bottom left right main site page primary secondary side inner outer slot unit module panel js".split())
#: Part of the page's text from which on an element, or an article, is the page and no part of it.
WHOLE, WHOLE_ARTICLE = 0.8, 0.5
#: Names that end in one of these mark reader comments, unless one of the others begins them.
READERS, NOT_PART = {"comments", "commentlist"}, set("has no with without is show hide enable disable".split())
#: Elements that no name marks.
NEVER = {"html", "body", "main", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3"}
CLOSES_P = BLOCKS - {"option"}
REPEATS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements whose content is no markup; all of them are dropped.
RAW = set("script style textarea title iframe noscript xmp".split())
#: Elements that an end tag is looked for upwards of, where another element can stop the search.
REACH = 1000
_TOKENS = re.compile("[a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARKUP = re.compile("<(?=[a-zA-Z/!?])")
_IN_TAG = re.compile(r"""[>]|=\s*["']""")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.IGNORECASE) for x in RAW}


def named(value: str) -> bool:
    """Whether one of the names in a class or id names a part that is no main text."""
    for x in value.split():
        parts = _TOKENS.findall(x)
        if not WORDS.isdisjoint(parts) and (WORDS | BESIDE).issuperset(parts):
            return True
        while parts and parts[-1] in BESIDE:
            parts.pop()
        if parts and parts[-1] in READERS and NOT_PART.isdisjoint(parts):
            return True
    return False


def _tag_end(html: str, at: int, failed: set[int], last: dict[str, int]) -> int:
    """Behind the tag that begins at `at`, or -1. failed: places from which no end was found before, so that each is tried once."""
    tried = []
    while m := _IN_TAG.search(html, at):
        if m[0] == ">":
            return m.end()
        if m.start() in failed:
            break
        tried.append(m.start())
        quote = m[0][-1]
        if last[quote] < m.end():
            break
        at = html.index(quote, m.end()) + 1
    failed.update(tried)
    return -1


def cut(html: str) -> Iterator[str]:
    """Pieces of a page for the parser: runs of text and whole tags, without comments, declarations and contents that are no markup."""
    last, failed = {x: html.rfind(x) for x in (">", '"', "'", "-->", "]]>")}, set()
    at, n = 0, len(html)
    while at < n:
        start = _MARKUP.search(html, at)
        if not start:
            yield html[at:]
            return
        begin = start.start()
        if begin > at:
            yield html[at:begin]
        after = html[begin + 1 : begin + 2]
        if after == "!" or after == "?" or after == "/" and not html[begin + 2 : begin + 3].isalpha():
            ends = "-->" if html.startswith("<!--", begin) else "]]>" if html.startswith("<![", begin) else ">"
            if ends == "-->" and html.startswith(("<!-->", "<!--->"), begin) or last[ends] < begin:
                ends = ">"
            if last[ends] < begin:
                return
            at = html.index(ends, begin) + len(ends)
            continue
        if last[">"] < begin:  # no tag ends any more
            return
        end = html.index(">", begin) + 1 if after == "/" else _tag_end(html, begin, failed, last)
        if end < 0:
            end = html.index(">", begin) + 1
        yield html[begin:end]
        at = end
        name = after != "/" and _NAME.match(html, begin + 1)[0].lower()
        if name in RAW and html[end - 2] != "/":
            closing = _RAW_END[name].search(html, at)
            at = closing.start() if closing else n


class Lines(HTMLParser):
    """Collects lines: (text, tags, number of the innermost element, region or -1, dropped, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, dropped (2: with its text, inside a line), region, number, region of the nearest block, heading
        self.open: list[tuple[str, int, int, int, int, str]] = [("", 0, -1, 0, -1, "")]
        self.counts: Counter = Counter()
        self.parts: list[str] = []
        self.tags = 0
        self.parent = [0]
        self.lines: list[tuple[str, int, int, int, bool, str]] = []
        self.outer: dict[int, int] = {}  # region -> the region around it
        self.boxes = {0}  # elements that can be the content region of a page without article or main
        self.named: set[int] = set()  # elements that their name, class or id marks as no main text

    def read(self, html: str) -> list[tuple[str, int, int, int, bool, str]]:
        for piece in cut(html):
            try:
                self.feed(piece)
            except AssertionError:  # markup that the parser refuses
                self.rawdata = ""
            if _MARKUP.match(self.rawdata):
                self.rawdata = ""
        self.close()
        self.line()
        return self.lines

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            self.lines.append((text, self.tags, top[3], top[4], bool(top[1]), top[5]))
            self.tags = 0
        self.parts = []

    def dropped(self, tag: str, attrs: list[tuple[str, str | None]], region: int) -> bool:
        if tag in DROPPED or tag == "header" and region < 0:
            return True
        for name, value in attrs:
            if name == "hidden":
                return True
            value = (value or "").lower()
            if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def pop_to(self, tag: str, within: set[str]) -> None:
        """Close the nearest open `tag`, unless one of `within` is nearer."""
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, max(0, len(self.open) - 1 - REACH) if within else 0, -1):
            if self.open[i][0] == tag:
                self.counts.subtract(x[0] for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.line()
            if tag in CLOSES_P:
                self.pop_to("p", {"article", "section", "div", "td", "li", "body", "main", "blockquote"})
            if tag in REPEATS:
                self.pop_to(tag, REPEATS[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, gone, region, around, block, heading = self.open[-1]
        number = len(self.parent)
        self.parent.append(around)
        if tag in BOXES:
            self.boxes.add(number)
        by_name = tag not in NEVER and any(n in ("class", "id") and named((v or "").lower()) for n, v in attrs)
        if tag == "form" or by_name:
            self.named.add(number)
        if tag in ("article", "main") and not gone:
            self.outer[number] = region
            gone, region = int(self.dropped(tag, attrs, region)), number
        elif not gone and self.dropped(tag, attrs, region):
            gone = 1 if tag in BLOCKS else 2
        self.counts[tag] += 1
        self.open.append((tag, gone, region, number, region if tag in BLOCKS else block, tag if tag in HEADINGS else heading))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.line()
        self.pop_to(tag, {"article", "main", "body"} - {tag} if tag in ("p", "b", "i", "em", "strong", "a", "span") else set())

    def handle_data(self, data: str) -> None:
        if self.open[-1][1] < 2:
            self.parts.append(data)

    def summed(self, of_lines: dict[int, float]) -> list[float]:
        """For each element what its lines and those of the elements inside it add up to."""
        out = [of_lines.get(e, 0) for e in range(len(self.parent))]
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inside(self, chosen: set[int]) -> list[bool]:
        """For each element whether it is, or lies in, one of `chosen`."""
        out = [0 in chosen]
        for e in range(1, len(self.parent)):
            out.append(e in chosen or out[self.parent[e]])
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.concatenate([np.zeros(reach), ratios, np.zeros(reach)])
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def by_names(parser: Lines, lines: list) -> np.ndarray:
    """The lines that are dropped for the names of the elements around them."""
    inside = parser.inside(parser.named)
    left = [i for i, x in enumerate(lines) if not x[4]]
    if not any(lines[i][3] >= 0 and not inside[lines[i][2]] for i in left):
        held, regions = {}, {}
        for i in left:
            text, _, element, region, *_ = lines[i]
            held[element] = held.get(element, 0) + len(text)
            if region >= 0 and region not in parser.named:
                regions[parser.parent[region]] = 1
        sizes, around = parser.summed(held), parser.summed(regions)
        inside = parser.inside({e for e in parser.named if not around[e] and sizes[e] <= sizes[0] * (WHOLE_ARTICLE if e in parser.outer else WHOLE)})
    gone = np.array([not x[4] and inside[x[2]] for x in lines])
    return gone if any(not gone[i] for i in left) else np.zeros(len(lines), bool)


def main_text(html: str | None) -> str:
    """The main text of one page: its lines joined by line feeds."""
    if not html:
        return ""
    parser = Lines()
    lines = parser.read(html)
    if not lines:
        return ""
    gone = np.array([x[4] for x in lines]) | by_names(parser, lines)
    ratios = np.where(gone, 0.0, np.array([len(x[0]) / max(1, x[1]) for x in lines]))
    curve = smoothed(ratios)
    content = ~gone & (curve >= curve.std())
    if not content.any():
        content = ~gone
    # Regions that hold lines of clusters count as wholes: the outermost ones and all inside them.
    root: dict[int, int] = {-1: -1}
    for region in sorted(parser.outer):
        root[region] = root[parser.outer[region]] if parser.outer[region] >= 0 else region
    chosen = {root[lines[i][3]] for i in np.flatnonzero(content).tolist()} - {-1}
    if chosen:
        kept = [root[x[3]] in chosen and not out for x, out in zip(lines, gone.tolist())]
    else:
        found: dict[int, int] = {}
        for i in np.flatnonzero(content).tolist():
            found[lines[i][2]] = found.get(lines[i][2], 0) + 1
        total = parser.summed(found)
        # The elements around all of them lie one inside the next, and the innermost has the highest number.
        best = parser.inside({max(e for e in parser.boxes if total[e] == total[0])})
        kept = [best[x[2]] and not out for x, out in zip(lines, gone.tolist())]
    first = kept.index(True) if True in kept else 0
    if not lines[first][5] and (titles := [i for i in range(first) if lines[i][5] == "h1" and not gone[i]]):
        kept[titles[-1] : first] = [not out for out in gone[titles[-1] : first].tolist()]
    return "\n".join(x[0] for x, stays in zip(lines, kept) if stays)


def extract(df: DataFrame, html: str = "html", id: str = "page_id", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, `keep` columns, text string, n_chars long of every page."""
    rows = df.select(F.col(id).alias(id), *keep, F.col(html).alias("body_html"))

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

        return apply

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string, n_chars long"
    return map_slices(rows, make, schema, "body_html")
