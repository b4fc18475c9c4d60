"""HTML extraction by differencing a page with the page of the nearest URL.

A page is cut into blocks of text. Within each host, pages are ordered by URL path, and
each path is paired with the neighbour that shares the longer beginning with it. The
blocks of a page are aligned with those of the neighbour by a longest common subsequence;
shared blocks are what the site repeats and are deleted.

Two checks by structure follow, because differencing alone can't be right on copied
articles and on boilerplate that varies from page to page. Shared blocks inside an
``article`` or ``main`` element stay. Blocks in elements made for menus, headers, footers,
sidebars, notices, adverts, forms or comments go, shared or not; class, id and role count
as whole names, and a form around the page's own structure is none of them. If a page has an
``article`` (or else a ``main``) element, only what is inside counts. One inside an element
to drop counts where no ``article`` stands outside, unless a ``main`` outside holds more. A
page that shares all its blocks is a copy, which tells nothing, so nothing is deleted.

Defined results: NULL or empty html has an empty text. Pages with a NULL or odd URL are of
one host without a neighbour. Repeated rows have repeated results. Unfinished markup at the
end of a page is no text. Extra columns are ignored.

Scale: one representative of each path (block hashes, no text) is range-partitioned by host
and path, so a host that holds a third of all pages is spread over many tasks; the rows at
the edges of partitions are paired in a second step over a few rows a partition. Pages are
shuffled once, to meet the hashes of their neighbour; a hot path is split by the join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.shingles import slices

# Elements whose content is never text, up to their end tag whatever stands between.
RAW = {"script", "style", "template", "noscript", "svg", "iframe", "textarea", "math", "object", "canvas"}
# Elements that never hold the article.
ASIDE = {"head", "title", "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset"}
# Whole names in class, id or role that tell the same of any element, as do names joined of them only.
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc",
    "header", "masthead", "footer", "contentinfo", "sidebar", "aside", "complementary", "widget",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "comment", "comments", "respond", "discussion", "disqus", "replies", "share", "sharing", "social", "related", "recommended",
    "search", "login", "signup", "form",
}
ASIDE_NAMES |= {f"{a}-{b}" for a in ("site", "main", "top", "bottom", "global", "primary", "secondary") for b in ("nav", "navbar", "navigation", "menu", "header", "footer")}
ASIDE_NAMES |= {
    "site-info", "nav-links", "widget-area", "sidebar-widget", "comments-area", "comment-list", "comments-list", "comment-section", "comments-section",
    "related-posts", "related-articles", "related-links", "related-content", "recommended-posts", "share-buttons", "share-links",
    "social-links", "social-icons", "social-media", "ad-container", "ad-wrapper", "ad-slot", "ad-unit", "ad-box", "cookie-bar", "cookie-policy", "search-box", "search-bar",
}
# Elements inside a block; all others begin and end one.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# What tells that a form is around the page, before its end tag.
_AROUND = re.compile(r"<(?:(h1|nav|footer|aside|main|article)|/form)\b", re.I)

# Where a block stands.
MAIN, PLAIN, BESIDE = 2, 1, 0


def _is_aside_name(name: str) -> bool:
    name = name.replace("_", "-").strip("-")
    return name in ASIDE_NAMES or ("-" in name and ASIDE_NAMES.issuperset(filter(None, name.split("-"))))


def _is_aside(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not in_main):
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for found in _NAMES.finditer(attributes):
            value = found[1] or found[2] or found[3] or ""
            if any(map(_is_aside_name, value.lower().split())):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order: text with single blanks, and where it stands."""
    # Texts with their container, "" outside of any and NULL in an aside, and whether that stands in an aside.
    out: list[tuple[str, str | None, bool]] = []
    text = page or ""
    has_article = "<article" in text or "<article" in text.lower()
    parts: list[str] = []
    depth = {"article": 0, "main": 0}
    beside, beside_depth = "", 0
    # Asides around the open container: name, level, what was open before, level of the name since.
    held: list[list] = []
    at = 0

    def close() -> None:
        if parts:
            joined = "".join(parts)
            clean = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if clean:
                out.append((clean, None if beside else "article" if depth["article"] else "main" if depth["main"] else "", bool(held)))
            parts.clear()

    while True:
        found = _TAG.search(text, at)
        if found is None:
            parts.append(text[at:])
            break
        if found.start() > at:
            parts.append(text[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag, ends = name.lower(), found[1] == "/"
        if tag in RAW and not ends:
            if not found[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(text, at)
                at = end.end() if end else len(text)
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        close()
        if beside:
            # The end is the end tag of the same name on the same level.
            if tag == beside:
                beside_depth += -1 if ends else 1
                if beside_depth == 0:
                    beside = ""
            elif ends and tag in ("body", "html"):
                beside = ""
                held.clear()
            elif tag in depth and not ends:
                held.append([beside, beside_depth, depth, 0])
                beside, depth = "", {"article": 0, "main": 0, tag: 1}
        elif tag in depth:
            depth[tag] = max(0, depth[tag] - 1) if ends else depth[tag] + 1
            if held and not any(depth.values()):
                beside, beside_depth, depth, _ = held.pop()
        elif not ends and tag == "form" and (around := _AROUND.search(text, at)) and around[1]:
            continue
        elif not ends and tag not in VOID and _is_aside(tag, found[3] or "", depth["article" if has_article else "main"] > 0):
            beside, beside_depth = tag, 1
        elif held and tag == held[-1][0]:
            held[-1][3] += -1 if ends else 1
            if held[-1][3] < 0:
                # The aside ends, and so does what was left open in it.
                beside, beside_depth, depth, _ = held.pop()
                beside_depth -= 1
                beside = beside if beside_depth else ""
    close()
    size = {(c, h): sum(len(t) for t, *x in out if x == [c, h]) for c in depth for h in (False, True)}
    if size["article", False]:
        main = ("article", False)
    else:
        main = max([("main", False), ("article", True)], key=lambda x: size[x])
        main = main if size[main] else ("main", True)
    return [(t, MAIN if (c, h) == main else PLAIN if c is not None and not h else BESIDE) for t, c, h in out]


def block_hashes(cut: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(text) - (1 << 63) for text, _ in cut]


# Alignment


def shared_places(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` that a longest common subsequence of both has."""
    begin, most = 0, min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    out = set(range(begin)) | set(range(len(a) - end, len(a)))
    inner_b = b[begin : len(b) - end]
    known = set(inner_b)
    # What occurs on one side only is in no common subsequence.
    mine = [i for i in range(begin, len(a) - end) if a[i] in known]
    theirs = set(a[i] for i in mine)
    _align(mine, [a[i] for i in mine], [x for x in inner_b if x in theirs], out)
    return out


def _align(places: list[int], a: list[int], b: list[int], out: set[int]) -> None:
    """Large tables are halved first, so that memory stays proportional to the shorter side."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.add(places[0])
        return
    if len(a) * len(b) <= 200_000:
        table = [[0] * (len(b) + 1)]
        for x in a:
            row, above = [0], table[-1]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
            table.append(row)
        i, j = len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.add(places[i - 1])
                i, j = i - 1, j - 1
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return
    half = len(a) // 2
    left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
    cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
    _align(places[:half], a[:half], b[:cut], out)
    _align(places[half:], a[half:], b[cut:], out)


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``, in bit-parallel rows."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    out, total = [0], 0
    for bit in reversed(f"{row:0{len(b)}b}" if b else ""):
        total += bit == "0"
        out.append(total)
    return out


def text_of(page: str | None, neighbour: list[int] | None) -> str:
    """The main text of a page, given the block hashes of its neighbour."""
    cut = blocks(page)
    shared: set[int] = set()
    if neighbour:
        shared = shared_places(block_hashes(cut), neighbour)
        if len(shared) == len(cut):
            shared = set()
    has_main = any(place == MAIN for _, place in cut)
    kept = (text for i, (text, place) in enumerate(cut) if place == MAIN or (place == PLAIN and not has_main and i not in shared))
    return " ".join(kept)


# Neighbours


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def _path() -> F.Column:
    return F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def _nearer(path: str, before: tuple | None, after: tuple | None) -> list[int] | None:
    """Hashes of the neighbour, of two given as path and hashes, whose path begins alike for longer."""

    def common(other: tuple | None) -> int:
        if other is None:
            return -1
        n = 0
        for x, y in zip(path, other[0], strict=False):
            if x != y:
                break
            n += 1
        return n

    chosen = before if common(before) >= common(after) else after
    return chosen[1] if chosen else None


def neighbours(pages: DataFrame) -> DataFrame:
    """``host, path, nearest``: the block hashes of the page whose path is nearest, NULL if the host has one path."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            lines = [block_hashes(blocks(p)) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("path"), pa.array(lines, pa.list_(pa.int64()))], ["host", "path", "lines"]
            )

    thin = pages.select(_host().alias("host"), _path().alias("path"), "html").mapInArrow(hashes, "host string, path string, lines array<long>")
    paths = thin.groupBy("host", "path").agg(F.min_by("lines", F.xxhash64("lines")).alias("lines"))

    columns = ["host", "path", "nearest", "lines", "near_path", "edge"]
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("nearest", pa.list_(pa.int64())), ("lines", pa.list_(pa.int64())), ("near_path", pa.string()), ("edge", pa.bool_())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: those with both neighbours at hand are done, the first and last of a task are edges."""
        before = now = None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "lines")), strict=True):
                if now is not None:
                    done.append(settled(before, now, row))
                before, now = now, row
            yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in done], schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(columns, settled(before, now, None), strict=True))], schema)

    def settled(before, now, after):
        near = [(r[1], r[2]) if r is not None and r[0] == now[0] else None for r in (before, after)]
        if before is None or after is None:
            # The neighbour on one side is in another task.
            inner = near[0] or near[1]
            return (now[0], now[1], inner[1] if inner else None, now[2], inner[0] if inner else None, True)
        return (now[0], now[1], _nearer(now[1], *near), None, None, False)

    ordered = paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path")
    paired = ordered.mapInArrow(pair, "host string, path string, nearest array<long>, lines array<long>, near_path string, edge boolean")

    # A task has at most two edges. The one before a first edge is the last edge of the task before.
    window = Window.partitionBy("host").orderBy("path")
    edges = paired.filter("edge").select(
        "host", "path", "nearest", "near_path",
        F.lag(F.struct("path", "lines")).over(window).alias("before"), F.lead(F.struct("path", "lines")).over(window).alias("after"),
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            nearest = []
            for r in rows:
                sides = [(r[s]["path"], r[s]["lines"]) if r[s] else None for s in ("before", "after")]
                inner = (r["near_path"], r["nearest"]) if r["near_path"] is not None else None
                # The inner neighbour is nearer than an edge beyond it on the same side.
                if inner is not None:
                    sides = [inner if sides[0] is None or inner[0] < r["path"] else sides[0], inner if sides[1] is None or inner[0] > r["path"] else sides[1]]
                    sides = [sides[0] if sides[0][0] < r["path"] else None, sides[1] if sides[1][0] > r["path"] else None]
                nearest.append(_nearer(r["path"], *sides))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(nearest, pa.list_(pa.int64()))], ["host", "path", "nearest"])

    settled_edges = edges.mapInArrow(choose, "host string, path string, nearest array<long>")
    return paired.filter("not edge").select("host", "path", "nearest").unionByName(settled_edges)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    near = neighbours(rows)
    joined = rows.withColumns({"host": _host(), "path": _path()}).join(near, ["host", "path"], "left")
    kind = rows.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = [text_of(p, n) for p, n in zip(batch.column("html").to_pylist(), batch.column("nearest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "nearest").mapInArrow(texts, f"page_id {kind}, url string, text string")
