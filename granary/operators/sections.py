"""HTML to sections, typed blocks and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.text import pack_greedy, tokens_estimate


#: Characters of html whose rows a worker holds at once.
HELD = 1_000_000


class _Blocks(HTMLParser):
    """(tag, text) of headings, paragraphs, list items, table rows and callouts, in order."""

    KINDS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.tag, self.skip = [], [], None, 0

    def close_block(self):
        text = " ".join("".join(self.held).split())
        if self.tag and text:
            self.out.append((self.tag, text.removesuffix("|").strip()))
        self.held, self.tag = [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.KINDS:
            self.close_block()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th"):
            self.held.append(" | ")
        elif tag == self.tag:
            self.close_block()

    def handle_data(self, data):
        if self.tag and not self.skip:
            self.held.append(data)


def parse(html: str | None) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.out


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, pos, tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, tag, text) for i, html in zip(b.column(0).to_pylist(), b.column(1), strict=True) for k, (tag, text) in enumerate(parse(html.as_py()))]
            i, k, tag, text = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(tag, pa.string()), pa.array(text, pa.string())], names=["page_id", "pos", "tag", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, pos long, tag string, text string")


def sections(found: DataFrame) -> DataFrame:
    """Blocks -> (page_id, section, title, depth, n_blocks, text): content goes to the heading before it; what
    comes before any heading, or has none, is a section named Document."""
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("tag").rlike("^h[1-6]$")
    rows = found.withColumn("section", F.sum(heading.cast("long")).over(order))
    title = F.max(F.when(heading, F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~heading, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return rows.groupBy("page_id", "section").agg(F.coalesce(title, F.lit("Document")).alias("title"), F.coalesce(F.max(F.when(heading, F.substring("tag", 2, 1).cast("long"))), F.lit(0).cast("long")).alias("depth"), F.count_if(~heading).alias("n_blocks"), text.alias("text"))


def packed(found: DataFrame, capacity: int) -> DataFrame:
    """Blocks (page_id, section, pos, text) -> chunks of at most `capacity` estimated tokens, in order; a longer
    block is a chunk of its own."""
    ordered = found.groupBy("page_id", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    sized = ordered.withColumn("g", pack_greedy(F.transform("b", lambda x: tokens_estimate(x["text"])), capacity))
    each = sized.select("page_id", "section", F.explode(F.arrays_zip("b", "g")).alias("z")).select("page_id", "section", F.col("z.g").alias("chunk_index"), "z.b.pos", "z.b.text")
    parts = each.groupBy("page_id", "section", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return parts.select("page_id", "section", "chunk_index", F.size("p").cast("long").alias("n_blocks"), text.alias("text"), tokens_estimate(text).alias("tokens"))


# --- the section tree ---

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Open elements that a start tag ends.
_ENDS = {"li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
_ENDS |= dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "section"), ("p",))
#: What stops the search for an element to end.
_HOLDS = frozenset(("ul", "ol", "table", "div", "section", "body", "article", "main"))


class Element:
    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Element]:
        rest = self.children[::-1]
        while rest:
            x = rest.pop()
            if isinstance(x, Element):
                yield x
                rest += x.children[::-1]

    def strings(self) -> Iterator[str]:
        rest = self.children[::-1]
        while rest:
            x = rest.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                rest += x.children[::-1]

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())


#: A tag as nearly all are written: attributes in double quotes, without references.
_TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")*)>')
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
#: Elements whose content isn't markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("body", {}, None)

    def end(self, tags: tuple[str, ...]) -> None:
        x = self.at
        while x.parent is not None and x.tag not in _HOLDS:
            if x.tag in tags:
                self.at = x.parent
            x = x.parent

    def handle_starttag(self, tag, attributes):
        if tag in ("html", "head", "body"):
            return
        self.end(_ENDS.get(tag, ()))
        new = Element(tag, {k: v or "" for k, v in attributes}, self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


    def feed_plain(self, text: str) -> bool:
        """The same as `feed` and `close` for a page on which every < begins a tag like `_TAG`, much faster; False, and nothing done, for others."""
        parts = _TAG.split(text)
        if text.count("<") != len(parts) // 4:
            return False
        names = [x.lower() for x in parts[2::4]]
        if not _RAW.isdisjoint(names) or any(slash and attributes for slash, attributes in zip(parts[1::4], parts[3::4], strict=True)):
            return False
        for data, slash, name, attributes in zip(["", *parts[4::4]], ["", *parts[1::4]], ["", *names], ["", *parts[3::4]], strict=True):
            if slash:
                self.handle_endtag(name)
            elif name:
                self.handle_starttag(name, [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else ())
            else:
                data = parts[0]
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
        return True


def tree(html: str | None) -> Element:
    parser = _Tree()
    if not parser.feed_plain(html or ""):
        parser.feed(html or "")
        parser.close()
    return parser.root


_HEADINGS = {f"h{n}": n for n in range(1, 7)}


def heading_depth(x: Element) -> int | None:
    """1 to 6 for h1 to h6, or for a class like heading2."""
    if x.tag in _HEADINGS:
        return _HEADINGS[x.tag]
    named = re.search("heading([1-6])", x.attributes["class"].lower()) if "class" in x.attributes else None
    return int(named[1]) if named else None


def names_callout(text: str) -> bool:
    low = text.lower()
    return any(n in low for n in L.CALLOUTS)


def table_rows(table: Element) -> tuple[list[str], list[list[str]]]:
    """Headers, those of the head or else of the first row, and all rows but those equal to them."""
    cells = lambda x: [c.text() for c in x.walk() if c.tag in ("td", "th")]
    rows = [cells(x) for x in table.walk() if x.tag == "tr"]
    head = next((x for x in table.walk() if x.tag == "thead"), None)
    headers = (cells(head) if head else []) or (rows[0] if rows else [])
    return headers, [r for r in rows if r and r != headers]


def typed_blocks(nodes: list[Element | str]) -> list[dict]:
    """Neighbouring nodes as blocks (kind, text, headers, rows): paragraphs and bullet lines that follow one another are one
    block; lists, tables and callouts stand alone. A block's text has one space for white space inside a line."""
    out: list[dict] = []
    paragraphs: list[str] = []
    bullets: list[str] = []

    def add(kind: str, text: str, headers: list[str] = (), rows: list[list[str]] = ()) -> None:
        out.append({"kind": kind, "text": text, "headers": list(headers), "rows": list(rows)})

    def flush() -> None:
        if paragraphs:
            add("paragraph", " ".join(paragraphs))
        if bullets:
            add("list", "\n".join(f"- {x}" for x in bullets))
        paragraphs.clear()
        bullets.clear()

    for x in nodes:
        text = " ".join(x.split()) if isinstance(x, str) else x.text()
        if isinstance(x, str):
            if text:
                paragraphs.append(text)
        elif x.tag in ("ul", "ol"):
            flush()
            items = [c.text() for c in x.children if isinstance(c, Element) and c.tag == "li"]
            if items:
                add("list", "\n".join(f"- {i}" for i in items))
        elif x.tag == "table":
            flush()
            headers, rows = table_rows(x)
            add("table", "\n".join(" | ".join(r) for r in rows), headers, rows)
        elif not text or x.tag in ("script", "style"):
            continue
        elif x.tag in ("p", "div", "section"):
            strong = next((c for c in x.walk() if c.tag in ("strong", "b")), None)
            if (strong and names_callout(strong.text())) or names_callout(" ".join(text.split()[:8])):
                flush()
                add("callout", text)
            elif re.match(r"[-•▪‣]\s+", text):
                bullets.append(text)
            else:
                paragraphs.append(text)
        else:
            paragraphs.append(text)
    # At the end bullet lines come before paragraphs.
    rest = list(paragraphs)
    paragraphs.clear()
    flush()
    paragraphs.extend(rest)
    flush()
    return out


def _anchor(heading: Element, links: dict[int, Element]) -> str | None:
    if heading.attributes.get("id"):
        return heading.attributes["id"]
    before = links.get(id(heading))
    if before is not None and "name" in before.attributes:
        return before.attributes["name"]
    inside = next((c for c in heading.walk() if c.tag == "a"), None)
    return (inside.attributes.get("name") or inside.attributes.get("id")) if inside else None


def section_tree(html: str | None) -> list[dict]:
    """Sections (number, title, depth, anchor, path, blocks) of a page: the blocks beside a heading up to the next one, its
    text before the first if that is a paragraph or list. A page without headings is one section, Document."""
    root = tree(html)
    found, links, last = [], {}, None
    for x in root.walk():
        if depth := heading_depth(x):
            found.append((x, depth))
            links[id(x)] = last
        if x.tag == "a":
            last = x
    if not found:
        return [{"number": None, "title": "Document", "depth": 1, "anchor": None, "path": "1", "blocks": typed_blocks(root.children)}]
    # Places of headings among the children of their parents.
    parents = {id(h.parent): h.parent for h, _ in found}
    places = {(parent, id(c)): i for parent, x in parents.items() for i, c in enumerate(x.children) if isinstance(c, Element)}
    out = []
    for k, (h, depth) in enumerate(found):
        text = h.text()
        numbered = re.match(r"(\d+(?:\.\d+)*)\s*(.*)$", text)
        number, title = (numbered[1], numbered[2] or numbered[1]) if numbered else (None, text)
        beside, at = h.parent.children, places[id(h.parent), id(h)] + 1
        stop = places.get((id(h.parent), id(found[k + 1][0])), len(beside)) if k + 1 < len(found) else len(beside)
        blocks = typed_blocks(beside[at:stop])
        if blocks and text and blocks[0]["kind"] in ("paragraph", "list"):
            blocks[0]["text"] = f"{text}\n\n{blocks[0]['text']}"
        out.append({"number": number, "title": title, "depth": depth, "anchor": _anchor(h, links), "path": number or f"{depth}.{k + 1}", "blocks": blocks})
    return out


BLOCK = "kind string, text string, headers array<string>, rows array<array<string>>"
TREE = f"file string, section long, number string, title string, depth long, anchor string, path string, blocks array<struct<{BLOCK}>>"


def by_page(batches: Iterator[pa.RecordBatch], made: Callable[[str, str | None], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What `made` makes of each page (file, html), sent on once `HELD` characters of html have been read: a worker never holds the rows of a
    whole batch."""
    rows, held = [], 0
    for b in batches:
        for file, html in zip(b.column(0), b.column(1), strict=True):
            text = html.as_py()
            rows += made(file.as_py(), text)
            held += len(text or "")
            if held >= HELD:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def section_blocks(pages: DataFrame) -> DataFrame:
    """(file, html) -> `TREE`, a row a section."""
    block = pa.struct([("kind", pa.string()), ("text", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
    schema = pa.schema([("file", pa.string()), ("section", pa.int64()), ("number", pa.string()), ("title", pa.string()), ("depth", pa.int64()), ("anchor", pa.string()), ("path", pa.string()), ("blocks", pa.list_(block))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_page(batches, lambda file, html: [{"file": file, "section": k, **x} for k, x in enumerate(section_tree(html))], schema)

    return pages.select(F.col("file").cast("string"), "html").mapInArrow(run, TREE)


def chunked(sections: DataFrame, capacity: int, overlap: int = 0, group: int = 10) -> DataFrame:
    """Sections (`TREE`) -> chunks with their metadata: callouts alone, tables by `group` rows, paragraphs and lists in turn up to
    `capacity` estimated tokens, a longer one in pieces."""
    rows = sections.where(F.size("blocks") > 0).select("file", "section", "number", "title", "anchor", "path", "blocks")
    cost = F.transform("blocks", lambda b: tokens_estimate(b["text"]))
    # A chunk begins at each callout, table and long block, behind these, and where the next block would pass the capacity.
    alone = F.transform(F.arrays_zip(F.col("blocks").alias("b"), cost.alias("n")), lambda z: z["b"]["kind"].isin("callout", "table") | (z["n"] > capacity))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("g"), F.lit(True).alias("shut"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, z: Column) -> Column:
        new = a["shut"] | z["alone"] | (a["used"] + z["n"] > capacity)
        g = a["g"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, z["n"]).otherwise(a["used"] + z["n"]).alias("used"), g.alias("g"), z["alone"].alias("shut"), F.array_append(a["out"], g).alias("out"))

    groups = F.aggregate(F.arrays_zip(cost.alias("n"), alone.alias("alone")), zero, step, lambda a: a["out"])
    each = rows.withColumn("__g", groups).select(*rows.columns[:-1], F.posexplode(F.arrays_zip(F.col("blocks").alias("b"), F.col("__g").alias("g"))).alias("pos", "z"))
    each = each.select(*rows.columns[:-1], F.col("pos").cast("long").alias("pos"), F.col("z.b").alias("b"), F.col("z.g").alias("g"))
    # One row a block; tables and long blocks give several texts.
    n_rows = F.size("b.rows")
    starts = F.sequence(F.lit(0), F.greatest(n_rows - 1, F.lit(0)), F.lit(group))
    tables = F.transform(starts, lambda s: F.struct(F.array_join(F.transform(F.slice("b.rows", s + 1, group), lambda r: F.array_join(r, " | ")), "\n").alias("text"), F.concat(s.cast("string"), F.lit("-"), F.least(n_rows, s + group).cast("string")).alias("table_group")))
    long = T.split_long(F.col("b.text"), capacity, overlap)
    none = F.lit(None).cast("string")
    one = F.array(F.struct(F.col("b.text").alias("text"), none.alias("table_group"), none.alias("split_part"), F.lit(0).alias("overlap")))
    parts = (
        F.when((F.col("b.kind") == "table") & (n_rows > 0), F.transform(tables, lambda t: F.struct(t["text"].alias("text"), t["table_group"].alias("table_group"), none.alias("split_part"), F.lit(0).alias("overlap"))))
        .when(~F.col("b.kind").isin("table", "callout") & (tokens_estimate(F.col("b.text")) > capacity), F.transform(long, lambda x, k: F.struct(x.alias("text"), none.alias("table_group"), F.concat((k + 1).cast("string"), F.lit("/"), F.size(long).cast("string")).alias("split_part"), F.lit(overlap).alias("overlap"))))
        .otherwise(one)
    )
    keys = ["file", "section", "number", "title", "anchor", "path"]
    texts = each.select(*keys, "pos", "g", F.col("b.kind").alias("kind"), F.posexplode(parts).alias("part", "p"))
    inside = F.array_sort(F.collect_list(F.struct("pos", "kind", F.col("p.text").alias("text"))))
    found = texts.groupBy(*keys, "g", "part").agg(inside.alias("x"), F.first("p.table_group", ignorenulls=True).alias("table_group"), F.first("p.split_part", ignorenulls=True).alias("split_part"), F.max("p.overlap").cast("long").alias("overlap_tokens"))
    text = F.array_join(F.filter(F.transform("x", lambda b: b["text"]), lambda t: t != ""), "\n\n")
    kinds = F.array_distinct(F.transform("x", lambda b: b["kind"]))
    number = F.coalesce("number", "path")
    hint = F.when(F.size(kinds) == 1, F.concat(F.lit(" — "), F.initcap(F.get(kinds, F.lit(0))))).otherwise("")
    return found.select(
        "file", "section", F.col("g").alias("chunk"), F.col("part").cast("long").alias("part"), text.alias("text"), tokens_estimate(text).alias("tokens"), F.col("path").alias("section_path"), number.alias("section_number"),
        F.col("title").alias("section_title"), F.coalesce("anchor", F.lit("")).alias("anchor_id"), F.array_join(F.array_sort(kinds), ",").alias("block_types"), F.array_join(T.form_codes(text), ",").alias("forms"), F.array_join(T.record_books(text), ",").alias("record_book"),
        F.trim(F.concat(number, F.lit(" "), F.coalesce("title", F.lit("")), hint)).alias("chunk_title"), F.get("x", F.lit(0))["pos"].alias("block_start"), F.element_at("x", -1)["pos"].alias("block_end"), "overlap_tokens", "table_group", "split_part",
    )


# --- headings and what follows ---


def merged_with_following(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(file, pos, tag, text, is_heading) -> (file, pos, text, n_merged): a heading takes up to `most` texts of the list items, lists
    and paragraphs that follow, to the next heading or other element; empty ones among them go. All else stays as it is."""
    order = Window.partitionBy("file").orderBy("pos")
    rows = nodes.withColumn("__g", F.sum(F.col("is_heading").cast("long")).over(order))
    inside = Window.partitionBy("file", "__g").orderBy("pos")
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    other = ~F.col("is_heading") & ~F.col("tag").isin("li", "p", "ul")
    rows = rows.withColumn("__broken", F.max(other).over(inside)).withColumn("__before", F.coalesce(F.count_if(filled & ~F.col("is_heading")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = (F.col("__g") > 0) & ~F.col("is_heading") & ~F.col("__broken") & (F.col("__before") < most)
    rows = rows.withColumn("__taken", taken).where(~taken | filled)
    head = rows.where("is_heading or __taken").groupBy("file", "__g").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    made = head.select("file", F.get("x", F.lit(0))["pos"].alias("pos"), F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("text"), (F.size("x") - 1).cast("long").alias("n_merged"))
    return made.unionByName(rows.where("not is_heading and not __taken").select("file", "pos", "text", F.lit(0).cast("long").alias("n_merged")))


def merged_in_pairs(nodes: DataFrame) -> DataFrame:
    """(file, pos, tag, text) -> (file, pos, text, tags): a heading (h1 to h6, or a short bold or capital paragraph) and the node after it,
    if that isn't an h1 to h6 and has a text, become one. Of nodes that could each take the next, every other one does."""
    order = Window.partitionBy("file").orderBy("pos")
    text, h = F.trim(F.coalesce("text", F.lit(""))), F.col("tag").rlike("^h[1-6]$")
    capital = text.rlike(r"(?U)\p{L}") & (F.upper(text) == text)
    bold = F.lower("text").contains("<strong>") | F.lower("text").contains("<b>")
    rows = nodes.select("file", "pos", "tag", text.alias("text"), h.alias("__h"), (h | ((F.col("tag") == "p") & (F.char_length(text) < 100) & (capital | bold))).alias("__heading"))
    rows = rows.withColumn("__next", F.lead("text").over(order)).withColumn("__next_tag", F.lead("tag").over(order))
    can = F.col("__heading") & (F.coalesce("__next", F.lit("")) != "") & ~F.coalesce(F.lead("__h").over(order), F.lit(False))
    rows = rows.withColumn("__can", can).withColumn("__n", F.row_number().over(order))
    start = F.max(F.when(~F.col("__can"), F.col("__n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__merges", F.col("__can") & ((F.col("__n") - F.coalesce(start, F.lit(0))) % 2 == 1))
    rows = rows.withColumn("__skipped", F.coalesce(F.lag("__merges").over(order), F.lit(False))).where("not __skipped")
    return rows.select("file", "pos", F.when(F.col("__merges"), F.concat_ws("\n\n", "text", "__next")).otherwise(F.col("text")).alias("text"), F.when(F.col("__merges"), F.concat_ws("+", "tag", "__next_tag")).otherwise(F.col("tag")).alias("tags"))


#: Elements whose texts become nodes of their own.
NODE_TAGS = ("h1", "h2", "h3", "ul", "li", "p")


def tag_nodes(html: str | None, tags: tuple[str, ...] = NODE_TAGS) -> list[tuple[str, str]]:
    """(tag, text) of runs of neighbouring elements of one kind; a list gives its whole text, and its items theirs again."""
    out: list[tuple[str, str]] = []
    for x in tree(html).walk():
        if x.tag in tags and (text := x.text()):
            if out and out[-1][0] == x.tag:
                out[-1] = (x.tag, f"{out[-1][1]}\n{text}")
            else:
                out.append((x.tag, text))
    return out


def node_rows(pages: DataFrame) -> DataFrame:
    """(file, html) -> (file, pos, tag, text)."""

    schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("tag", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_page(batches, lambda file, html: [{"file": file, "pos": k, "tag": tag, "text": text} for k, (tag, text) in enumerate(tag_nodes(html))], schema)

    return pages.select(F.col("file").cast("string"), "html").mapInArrow(run, "file string, pos long, tag string, text string")
