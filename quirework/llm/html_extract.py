"""Main text of web pages by nearest-URL differencing.

Pages of a host are ordered by URL path. Each is paired with the nearer of the two pages beside it, the one whose path begins like its
own for longer, which is most likely made from the same template. A longest common subsequence aligns the lines of the two, and of the unmarked
lines those that both share go. Marks decide where there are any. Lines in a marked article stay even if they are
shared, for copied and quoted articles are neighbours as well; and lines in marked menus, headers, footers, sidebars, notices,
adverts, forms, comments and scripts go, shared or not. On pages that mark everything differencing so decides nothing.

Pages are dealt out by ranges of the order, so a host with a third of all pages is spread over many tasks. The pages at both ends of a
range also go to the ranges beside it, as guests to be compared with, so that no result depends on where ranges are cut.
"""

from __future__ import annotations

import bisect
import os.path
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import batch, durable
from quirework.llm.url_filter import url_parts

# Elements that start and end a block, that hold no text, that are never main text, and words of class, id or role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video head title select option textarea button datalist".split())
AROUND = frozenset("nav header footer aside form menu dialog".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
AROUND_PARTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser teasers toolbar widget widgets".split())
HEADER_PARTS = frozenset("header heading masthead".split())
#: Parts of a name that may stand beside those, as in comment-list or site-footer.
BESIDE_PARTS = frozenset("area bar block body bottom box buttons card cards container content form global inner items left links list main outer page pages panel policy primary reader readers right secondary section site slot text thread tools top unit user users wrap wrapper".split())
BESIDE_ARTICLE = frozenset("article articles entry post posts stories story".split())
#: Elements inside an article whose name can take them out of it; a heading or a paragraph with a telling name is text.
PARTS_OF_ARTICLE = frozenset("article aside details div dl form iframe ol section table ul".split())
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|article-body|content|entry-content|main|main-content|post|post-body|post-content|story)(?:$|[\s_-])", re.I)
#: Open elements that a new block of the same kind closes, and those that a block closes.
CLOSED_BY_BLOCK = frozenset(("p",))
SELF_CLOSING = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
SPACE = re.compile(r"\s+")

ARTICLE, AROUND_IT, OPEN = "article", "around", "open"
#: Pairs of equal lines up to which an alignment goes by them; beyond, it goes by bit vectors. Both are exact.
MATCHES = 1 << 20
#: Bytes of markup in a range of pages, about, and ranges at most; this bounds the table of their ends.
RANGE_BYTES = 16 << 20
MAX_RANGES = 20_000
ORDER = ("host", "path", "page_id", "url", "tie")


def named_around(names: str, header: bool) -> bool:
    """Whether one of the names (a class or an id) says that an element is no main text: it is made of such a part and of parts that say nothing."""
    for name in names.split():
        parts = {p for p in re.split(r"[\W_]+", name.lower()) if p and not p.isdigit()}
        rest = parts - AROUND_PARTS
        if len(rest) < len(parts) and rest <= BESIDE_PARTS | BESIDE_ARTICLE:
            return True
        if header and parts & HEADER_PARTS and parts <= HEADER_PARTS | BESIDE_PARTS:
            return True
    return False


class Lines(HTMLParser):
    """Reads a page as lines (zone, text), one a block, in page order; references decoded, white space as one space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.stack: list[tuple[str, str, bool]] = []  # element, zone inside, silent

    def zone(self) -> tuple[str, bool]:
        return self.stack[-1][1:] if self.stack else (OPEN, False)

    def end_block(self) -> None:
        line = SPACE.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if line:
            self.lines.append((self.zone()[0], line))

    def close(self) -> None:
        super().close()
        self.end_block()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self.end_block()
            self.pop_until(CLOSED_BY_BLOCK, stop=frozenset(("table", "button", "body", "article", "div", "section", "td", "li", "blockquote")))
            if tag in SELF_CLOSING:
                self.pop_until(SELF_CLOSING[tag], stop=frozenset(("ul", "ol", "dl", "table", "tbody", "select", "body")))
        if tag in VOID:
            return
        zone, silent = self.zone()
        found = {k: v or "" for k, v in attrs}
        named = f"{found.get('class', '')} {found.get('id', '')}"
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""))
        in_article = zone == ARTICLE
        if tag in ("body", "html"):
            pass
        elif any(k == "data-ad" or k.startswith("data-ad-") for k in found):
            zone = AROUND_IT
        elif tag in AROUND and not (tag == "header" and in_article) or found.get("role", "") in AROUND_ROLES:
            zone = AROUND_IT
        elif tag != "main" and (not in_article or tag in PARTS_OF_ARTICLE) and named_around(named, header=not in_article and tag != "article"):
            zone = AROUND_IT
        elif zone == OPEN and (tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody" or (tag in ("div", "section") and MAIN_WORDS.search(named))):
            zone = ARTICLE
        self.stack.append((tag, zone, bool(silent or hidden or tag in SILENT)))

    def pop_until(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Closes an open element of these, if there is one inside the innermost of stop."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in ("article", "main", "nav", "footer", "table") and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self.zone()[1]:
            self.text.append(data)


def page_lines(html: str) -> list[tuple[str, str]]:
    """(zone, line) of a page in order; a page cut short or with unclosed elements is read as far as it goes."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser.lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    same = {*range(start), *range(len(a) - end, len(a))}
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    by_matches = sum(len(places.get(line, ())) for line in a) <= MATCHES
    return same | {start + i for i in (_by_matches(a, places) if by_matches else _by_bits(a, b))}


def _by_matches(a: list[str], places: dict[str, list[int]]) -> set[int]:
    """Hunt and Szymanski: for each line of a, its places in b from the last to the first, keeping the least end of a common run of each length."""
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    kept: set[int] = set()
    at = links[-1] if links else None
    while at:
        kept.add(at[0])
        at = at[1]
    return kept


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """For each j the length of a longest common subsequence of a and the first j of b; a row of the table is one long integer."""
    masks: dict[str, int] = {}
    by_line: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        by_line.setdefault(line, []).append(j)
    for line, at in by_line.items():
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        masks[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        met = row & masks.get(line, 0)
        row = ((row + met) | (row - met)) & full
    zeros = 1 - np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def _by_bits(a: list[str], b: list[str]) -> set[int]:
    """Hirschberg: cuts a in halves and b where the lengths of both sides add up to most; in memory of the order of a and b."""
    kept: set[int] = set()
    left = [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                kept.add(a0)
            continue
        middle = (a0 + a1) // 2
        head, tail = _lengths(a[a0:middle], b[b0:b1]), _lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(head + tail))
        left += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return kept


Page = list[tuple[str, str]]


def main_text(lines: Page, neighbour: Page | None) -> tuple[str, int, int]:
    """(text, unmarked lines that went because the neighbour shares them, lines that went by their marks); blocks joined by an empty line.

    If nothing would be left because the neighbour shares all unmarked lines of a page without an article, the two are copies, and the
    neighbour tells nothing about them.
    """
    shared = common_lines([line for _, line in lines], [line for _, line in neighbour]) if neighbour else set()
    kept = [k for k, (zone, _) in enumerate(lines) if zone == ARTICLE or zone == OPEN and k not in shared]
    if not kept:
        kept = [k for k, (zone, _) in enumerate(lines) if zone == OPEN]
    n_shared = sum(lines[k][0] == OPEN for k in shared.difference(kept))  # marked surroundings would go without a neighbour
    return "\n\n".join(lines[k][1] for k in kept), n_shared, len(lines) - len(kept) - n_shared


def nearer(path: str, lines: Page, before: tuple[str, Page] | None, after: tuple[str, Page] | None) -> Page | None:
    """Of the (path, lines) beside a page, those of the path that begins like its own for longer, else the one before; copies of the page tell nothing."""
    found = [x for x in (before, after) if x is not None and x[1] != lines]
    return max(found, key=lambda x: len(os.path.commonprefix((path, x[0]))))[1] if found else None


def _ranges(keys: DataFrame, size: str) -> list[tuple[tuple, tuple]]:
    """(first, last) key of each range of the order, MAX_RANGES at most, about equal in bytes of markup."""
    keys = durable(keys)
    total = keys.agg(F.sum(size)).first()[0] or 0
    parts = min(MAX_RANGES, 1 + total // RANGE_BYTES)
    dealt = keys.repartitionByRange(parts, *ORDER).select(F.spark_partition_id().alias("part"), F.struct(*ORDER).alias("key"))
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    return sorted((_key(*r["first"]), _key(*r["last"])) for r in ends)


def _key(host: str, path: str, page_id: int | None, url: str | None, tie: int) -> tuple:
    """A key in the order of Spark: nulls first, strings by code point."""
    return host, path, page_id is not None, page_id or 0, url is not None, url or "", tie


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_shared, n_marked (unmarked lines that went by differencing, and lines that went by marks).

    Null html counts as empty and gives empty text. A null URL or one without host is a host of its own. Pages with equal URLs are
    neighbours, ordered by id and html; of repeated rows each is extracted. Ids may be null or repeat. Other columns are ignored; an
    empty table gives an empty result. The same pages give the same rows however they are partitioned.
    """
    host, path = url_parts(pages[url_col])
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), html.alias("html"), host.alias("host"), path.alias("path"), F.xxhash64(html).alias("tie"))
    ranges = _ranges(rows.select(*ORDER, F.octet_length("html").cast("long").alias("size")), "size")
    shared = pages.sparkSession.sparkContext.broadcast(ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the number of its range, and as a guest with those of the ranges beside it if it is at an end."""
        firsts = [first for first, _ in shared.value]
        for b in batches:
            take, part, guest = [], [], []
            for k, fields in enumerate(zip(*(b.column(c).to_pylist() for c in ORDER), strict=True)):
                key = _key(*fields)
                own = bisect.bisect_right(firsts, key) - 1
                first, last = shared.value[own]
                beside = [own - 1] * (key == first and own > 0) + [own + 1] * (key == last and own + 1 < len(firsts))
                for n, p in enumerate((own, *beside)):
                    take.append(k), part.append(p), guest.append(n > 0)
            got = b.take(pa.array(take, pa.int64()))
            yield batch(**{c: got.column(c) for c in (*ORDER, "html")}, part=pa.array(part, pa.int32()), guest=pa.array(guest, pa.bool_()))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # (part and host), (path, lines) of the page before the one in hand
        hand: tuple | None = None  # (part and host), (path, lines), guest, page_id, url
        out: list[tuple] = []

        def close(after: tuple | None) -> None:
            """Extracts the page in hand."""
            if hand is not None and not hand[2]:
                beside = [x[1] if x is not None and x[0] == hand[0] else None for x in (before, after)]
                out.append((*hand[3:], *main_text(hand[1][1], nearer(*hand[1], *beside))))

        def rows_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * 5
            kinds = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()
            got = batch(**{c: pa.array(x, kind) for c, x, kind in zip(("page_id", "url", "text", "n_shared", "n_marked"), columns, kinds, strict=True)})
            out.clear()
            return got

        for b in batches:
            for page_id, url, html, host, path, part, guest in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "path", "part", "guest")), strict=True):
                page = (part, host), (path, page_lines(html)), guest, page_id, url
                close(page)
                before, hand = hand, page
            yield rows_of()
        close(None)
        yield rows_of()

    dealt = rows.mapInArrow(deal, "host string, path string, page_id long, url string, tie long, html string, part int, guest boolean")
    ordered = dealt.repartitionById(max(1, len(ranges)), "part").sortWithinPartitions("part", *ORDER)
    got = ordered.mapInArrow(extract, "page_id long, url string, text string, n_shared long, n_marked long")
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")
