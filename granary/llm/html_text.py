"""Main text of web pages by nearest-URL page differencing.

Pages are cut into text blocks, lines, by a small tag scanner, which also tells what markup says about
each: inside the article (or main) element, inside a menu, header, footer, sidebar, form, notice,
advert or comment list, or undecided. All lines of all pages are differenced: pages are sorted by host and
URL path, each is paired with the neighbour on its host whose path shares more leading parts (the one
before at a tie), lines of the two are aligned by longest common subsequence, and the shared ones
are template. Where differencing and markup disagree, markup decides: a shared line inside an article
stays, for pages may quote one another, and a line of its own inside an advert goes. A page that has an
article keeps the article alone.

Pages of one host with equal lines are one node, under the first of their paths, so copies aren't paired with
one another. Nodes carry hashes of lines, not texts. Their sort is by range of (host, path), so a host with any
number of pages is spread over partitions; what lies at the edges of a partition, two nodes at most, meets its
neighbours in a second step, so the result doesn't depend on the partitions.

Null html is empty, and so is the text of a page without blocks; empty pages are paired with none. Null
URLs form a host of their own. Repeated rows are kept. An empty table gives no rows. A very long page is
aligned in memory that grows with its lines, not with their square.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_SPACE = re.compile(r"[\s ]+")
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "title", "textarea", "select", "audio", "video")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*(?:>|\Z)", re.I) for t in _RAW}
_BOILER = frozenset(("nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"))
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that close an open element of the named kinds.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|overlay|side-?bar|widget|menu|nav(?:bar|igation)?|bread-?crumbs?|header|footer|masthead|comments?(?:-?list)?|disqus|replies|respond|related|recommend(?:ed|ations)?|share|sharing|social|toolbar|login|signup|pagination|pager|copyright|skip-?link)(?:$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"))


def _boiler(tag: str, attributes: str, inside: int = 0) -> bool:
    """Whether an element is template by its markup. inside: open articles around it; comments are often articles in one."""
    if tag in _BOILER:
        return True
    if tag == "article" and attributes:
        named = _NAMED if inside else _COMMENT
        return any(name.lower() in ("class", "id") and named.search(value.strip("\"'")) for name, value in _ATTR.findall(attributes))
    if attributes and tag not in ("html", "body", "main"):
        for name, value in _ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if (name in ("class", "id") and _NAMED.search(value)) or (name == "role" and value.lower() in _ROLES):
                return True
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return True
    return False


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block in page order. Kind: 2 inside an article or main element, 1 undecided,
    0 template by its markup."""
    html = html or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, starts template?, starts article?
    held: list[str] = []
    boiler = article = 0
    at, head = 0, False

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(held))).strip()
        held.clear()
        if text and not head:
            out.append((0 if boiler else 2 if article else 1, text))

    def close(tag: str) -> None:
        nonlocal boiler, article
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                for _, b, a in stack[k:]:
                    boiler -= b
                    article -= a
                del stack[k:]
                return
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and stack[k][0] in ("table", "article", "main", "ul", "ol", "dl", "body"):
                return

    while True:
        found = _TAG.search(html, at)
        if found is None:
            held.append(html[at:])
            break
        held.append(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not found[1] and tag in _RAW:
            if tag != "title" or not found[3].rstrip().endswith("/"):
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in _BLOCK:
            flush()
        if found[1]:
            if tag == "head":
                head = False
            close(tag)
            continue
        if tag == "head":
            head = True
        elif tag == "body":
            head = False
        if tag in _VOID or found[3].endswith("/"):
            continue
        for kind in _CLOSES.get(tag, ()):
            close(kind)
        if tag in _CLOSE_P and tag != "p":
            close("p")
        b, a = _boiler(tag, found[3], article), tag in ("article", "main")
        if b and article and tag == "header":
            b = False  # an article's own heading
        boiler += b
        article += a
        if tag in _BLOCK or b:
            stack.append((tag, b, a))
    flush()
    return out


def path_of(url: str | None) -> tuple[str, str]:
    """(host, path) without scheme, query and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.netloc.lower(), parts.path.rstrip("/"))
    except ValueError:
        return ("", url or "")


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a and each start of b, by bit-parallel addition."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list, b: list, first: int, out: set[int]) -> None:
    """Put indices (from `first` on) of a's lines in a longest common subsequence with b into out; linear memory."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.add(first + head)
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        out.add(first + len(a) - 1 - tail)
        tail += 1
    a, b, first = a[head : len(a) - tail], b[head : len(b) - tail], first + head
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.add(first)
        return
    middle = len(a) // 2
    k = int(np.argmax(_lengths(a[:middle], b) + _lengths(a[:middle - 1 : -1], b[::-1])[::-1]))
    _aligned(a[:middle], b[:k], first, out)
    _aligned(a[middle:], b[k:], first + middle, out)


def shared_lines(a: list, b: list) -> set[int]:
    """Indices of a's lines in a longest common subsequence with b."""
    common = set(a) & set(b)
    kept = [i for i, x in enumerate(a) if x in common]
    found: set[int] = set()
    _aligned([a[i] for i in kept], [x for x in b if x in common], 0, found)
    return {kept[k] for k in found}


def _hashes(found: list[tuple[int, str]]) -> tuple[bytes, bytes]:
    return bytes(kind for kind, _ in found), b"".join(xxhash.xxh3_64_digest(t) for _, t in found)


def digest_of(found: list[tuple[int, str]]) -> int:
    """One number for a page's lines and what markup says of them."""
    return int.from_bytes(xxhash.xxh3_64_digest(b"".join(_hashes(found))), "big", signed=True)


_LINES = "kinds binary, hashes binary"
_SCANNED = f"page_id long, url string, host string, path string, digest long, {_LINES}, article string, lines array<string>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) -> `_SCANNED`: what markup says of each line, the lines' hashes, and the article's text,
    or all lines of a page without one."""
    names = ["page_id", "url", "host", "path", "digest", "kinds", "hashes", "article", "lines"]
    for b in batches:
        ids, urls, html = b.columns
        out: list[list] = [[] for _ in names[2:]]
        for url, page in zip(urls.to_pylist(), html, strict=True):
            found = blocks(page.as_py())
            kinds, hashes = _hashes(found)
            article = [t for kind, t in found if kind == 2]
            row = (*path_of(url), digest_of(found), kinds, hashes, "\n".join(article) if article else None, None if article else [t for _, t in found])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds_of = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([ids, urls, *(pa.array(x, t) for x, t in zip(out, kinds_of, strict=True))], names=names)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


class Node(NamedTuple):
    host: str
    path: str
    digest: int
    kinds: bytes
    hashes: bytes

    @property
    def lines(self) -> list[bytes]:
        return [self.hashes[k : k + 8] for k in range(0, len(self.hashes), 8)]


def dropped(own: Node, before: Node | None, after: Node | None) -> list[int]:
    """Lines of a page that go: template by markup, or shared with the nearer neighbour and not inside an article;
    if there is an article, all that's outside it."""
    near = [x for x in (before, after) if x is not None and x.host == own.host]
    best = max(near, key=lambda x: _common(x.path, own.path), default=None)
    shared = shared_lines(own.lines, best.lines) if best else set()
    article = 2 in own.kinds
    return [k for k, kind in enumerate(own.kinds) if kind == 0 or (kind == 1 and (article or k in shared))]


_NODE = "host string, path string, digest long, kinds binary, hashes binary"
_PAIRED = f"part long, edge int, host string, digest long, gone array<int>, node struct<{_NODE}>, near struct<{_NODE}>"
_NODE_TYPE = pa.struct([("host", pa.string()), ("path", pa.string()), ("digest", pa.int64()), ("kinds", pa.binary()), ("hashes", pa.binary())])
_FIRST, _LAST, _ONLY, _INNER = 0, 1, 2, 3


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes -> the lines of each that go; the first and the last of a partition, whose neighbours aren't all here,
    are passed on with the one that is."""
    part = TaskContext.get().partitionId()

    def nodes() -> Iterator[Node]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                yield from map(Node._make, zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), _NODE_TYPE, _NODE_TYPE)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "edge", "host", "digest", "gone", "node", "near"])

    def edge(kind: int, own: Node, near: Node | None) -> tuple:
        return (part, kind, own.host, own.digest, None, own._asdict(), near and near._asdict())

    out: list[tuple] = []
    before = own = None
    for after in nodes():
        if own is not None:
            out.append(edge(_FIRST, own, after) if before is None else (part, _INNER, own.host, own.digest, dropped(own, before, after), None, None))
        before, own = own, after
        if len(out) >= 1000:
            yield batch(out)
            out = []
    if own is not None:
        out.append(edge(_ONLY if before is None else _LAST, own, before))
    yield batch(out)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, before, after) -> (host, digest, gone)."""
    for b in batches:
        node = lambda x: x and Node(**x)
        rows = [(own["host"], own["digest"], dropped(node(own), node(x), node(y))) for own, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["host", "digest", "gone"])


def template(pages: DataFrame) -> DataFrame:
    """`_SCANNED` rows -> (host, digest, gone): the lines of each node that go."""
    nodes = pages.where(F.octet_length("kinds") > 0).groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("kinds").alias("kinds"), F.first("hashes").alias("hashes"))
    nodes = stored(nodes.select("host", "path", "digest", "kinds", "hashes"), "html-nodes")
    dealt = nodes.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest")
    paired = stored(dealt.mapInArrow(_paired, _PAIRED), "html-paired")
    # Partitions that have nodes, in order: one number each.
    order = Window.orderBy("part")
    parts = paired.select("part").distinct().select("part", F.lag("part").over(order).alias("lower"), F.lead("part").over(order).alias("upper"))
    edges = paired.where(f"edge <> {_INNER}").join(F.broadcast(parts), "part")
    ends = edges.where(f"edge <> {_FIRST}").select(F.col("part").alias("lower"), F.col("node").alias("below"))
    starts = edges.where(f"edge <> {_LAST}").select(F.col("part").alias("upper"), F.col("node").alias("above"))
    met = edges.join(ends, "lower", "left").join(starts, "upper", "left")
    before = F.when(F.col("edge") == _LAST, F.col("near")).otherwise(F.col("below"))
    after = F.when(F.col("edge") == _FIRST, F.col("near")).otherwise(F.col("above"))
    last = met.select("node", before.alias("before"), after.alias("after")).mapInArrow(_at_edges, "host string, digest long, gone array<int>")
    return paired.where(f"edge = {_INNER}").select("host", "digest", "gone").unionByName(last)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text)."""
    scanned = stored(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_scan, _SCANNED), "html-scanned")
    # An article is whole as it is and needs no join; lines of the other pages are looked up.
    whole, open_ = scanned.where("lines is null"), scanned.where("lines is not null")
    gone = template(scanned).join(stored(open_.select("host", "digest").distinct(), "html-open"), ["host", "digest"], "left_semi")
    kept = F.filter("lines", lambda x, k: ~F.array_contains("gone", k))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n")
    rest = open_.join(gone, ["host", "digest"], "left").select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
    return whole.select("page_id", "url", F.coalesce("article", F.lit("")).alias("text")).unionByName(rest)


def op9_html(pages: DataFrame) -> DataFrame:
    return main_texts(pages).withColumn("n_chars", F.char_length("text").cast("long"))
