"""Text, identity and result-shaping scalars: Column expressions only."""

from __future__ import annotations

import html
import re
from functools import reduce
from html import entities
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: A character reference with its semicolon.
_CLOSED = re.compile("&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _decode(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references as characters: Spark has no function for the whole of them."""
    return F.pandas_udf(_decode, "string")(text)


def _decode_closed(text: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        return html.unescape(m[0]) if m[1][0] == "#" else entities.html5.get(f"{m[1]};", m[0])

    return text.map(lambda x: _CLOSED.sub(one, x), na_action="ignore")


def unescaped(text: Column, closed: bool = False) -> Column:
    """Text without character references. The few that pages have most are replaced by plain functions; whatever else looks like one is
    left to `unescape`, whose rows are blank otherwise. closed: what lacks the semicolon is text (of a title that was cut, say)."""
    plain = text
    for name, character in (("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "\u00a9"), ("middot", "\u00b7"), ("#39", "'"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    rare = F.regexp_replace(text, "&(?:nbsp|lt|gt|quot|copy|middot|#39|amp);", " ").rlike(_CLOSED.pattern if closed else "&(?:#|[A-Za-z])")
    decoded = F.pandas_udf(_decode_closed, "string") if closed else unescape
    return F.when(rare, decoded(F.when(rare, text))).otherwise(plain)


def strip_tags(html: Column, closed: bool = False) -> Column:
    """Text without scripts, styles and tags; character references are decoded, with closed those that end with a semicolon."""
    out = F.regexp_replace(html, r"(?is)<\s*script[^>]*>.*?</\s*script\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<\s*style[^>]*>.*?</\s*style\s*>", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(out, r"<[^>]+>", " "), closed), r"(?U)\s+", " "))


_SCRIPT = re.compile(r"(?is)<\s*script[^>]*>.*?</\s*script\s*>", re.A)
_STYLE = re.compile(r"(?is)<\s*style[^>]*>.*?</\s*style\s*>", re.A)
_MARKUP, _BLANKS = re.compile("<[^>]+>"), re.compile(r"[^\S\x1c-\x1f]+")


def stripped(text: str) -> str:
    """What `strip_tags` makes of one text, where it's read in Python anyway."""
    if "<" in text:
        text = _MARKUP.sub(" ", _STYLE.sub(" ", _SCRIPT.sub(" ", text)))
    return _BLANKS.sub(" ", html.unescape(text) if "&" in text else text).strip(" ")


def whole_text(html: Column, closed: bool = False) -> Column:
    """All text of a document, scripts and styles too, without comments and tags; references as in `strip_tags`."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->|<!\w[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(out, r"</?[A-Za-z][^>]*>", " "), closed), r"(?U)\s+", " "))


def normal_title(text: Column) -> Column:
    """Without a leading section number, lower case, single spaces."""
    return collapse(F.lower(F.regexp_replace(F.trim(text), r"^\s*[\d\.]+\s*", "")))


def heading_number(text: Column) -> Column:
    """struct<number, title> of "4.3 Title"; a bare number is its own title."""
    number, title = F.regexp_extract(text, r"(?s)^\s*(\d+(?:\.\d+)*)\s*(.*)$", 1), F.regexp_extract(text, r"(?s)^\s*(\d+(?:\.\d+)*)\s*(.*)$", 2)
    return F.when(number == "", F.struct(F.lit("").alias("number"), F.trim(text).alias("title"))).otherwise(F.struct(number.alias("number"), F.when(F.trim(title) == "", number).otherwise(F.trim(title)).alias("title")))


def slug(title: Column, size: int = 120) -> Column:
    made = F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-")
    made = F.left(F.regexp_replace(made, r"^-+|-+$", ""), F.lit(size))
    return F.when(made == "", F.concat(F.lit("sec-"), F.left(F.sha1(title.cast("binary")), F.lit(10)))).otherwise(F.concat(F.lit("sec-"), made))


def title_guess(title: Column, heading: Column, text: Column) -> Column:
    """The title, else the heading's first line, else the first sentence; 180 characters at most."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = lambda c, cut: filled(F.get(F.split(c, cut, 2), F.lit(0)))
    return F.left(F.coalesce(filled(title), first(heading, "\n"), first(text, r"(?<=[.!?])\s+")), F.lit(180))


def breadcrumb(file: Column, title: Column) -> Column:
    return F.concat_ws(" > ", F.regexp_replace(file, r"\.[^./]*$", ""), F.nullif(title, F.lit("")))


def tokens_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("long"))


def form_codes(text: Column) -> Column:
    codes = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bF0*\d{2,3}\b"), 0), lambda c: F.upper(c))
    return F.array_sort(F.array_distinct(codes))


def heading_like(text: Column, words: tuple[str, ...] = L.HEADING_WORDS) -> Column:
    """A short single line that ends with a colon, is in title or upper case, or has a heading word in five."""
    t = F.trim(text)
    cased = t.rlike(r"(?U)\p{L}")
    upper = cased & (F.upper(t) == t)
    title = cased & (t == F.initcap(t)) & ~t.rlike(r"(?U)[\p{L}]*\p{Lu}\p{Lu}")
    named = t.rlike("(?i)" + "|".join(words)) & (F.size(F.split(t, r"\s+")) <= 5)
    return (t != "") & (F.char_length(t) < 100) & ~t.contains("\n") & (t.endswith(":") | upper | title | named)


def table_groups(n: Column, size: int = 10) -> Column:
    """Labels "1-10", "11-20", ... of n table rows."""
    starts = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"), F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.concat(s.cast("string"), F.lit("-"), F.least(s + size - 1, n.cast("long")).cast("string")))


def pack_greedy(sizes: Column, capacity: int) -> Column:
    """Group number of each size in turn: a group closes when the next size would pass the capacity."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("group"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = (a["used"] > 0) & (a["used"] + s > capacity)
        group = a["group"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, s).otherwise(a["used"] + s).alias("used"), group.alias("group"), F.array_append(a["out"], group).alias("out"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), zero, step, lambda a: a["out"])


def split_long(text: Column, most: int, overlap: int) -> Column:
    """Word windows of `most` estimated tokens (a word counts a quarter of its length plus one) that step
    back overlap // 4 words; a step always moves on."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("now"), F.array().cast("array<string>").alias("out"))
    back = overlap // 4

    def step(a: Column, w: Column) -> Column:
        cost = F.floor(F.char_length(w) / 4).cast("long") + 1
        full = (a["used"] > 0) & (a["used"] + cost > most)
        n = F.least(F.lit(back), F.size(a["now"]) - 1)
        kept = F.when(n > 0, F.slice(a["now"], F.size(a["now"]) - n + 1, n)).otherwise(F.array().cast("array<string>"))
        used = F.aggregate(kept, F.lit(0).cast("long"), lambda x, y: x + F.floor(F.char_length(y) / 4).cast("long") + 1)
        return F.when(full, F.struct((used + cost).alias("used"), F.array_append(kept, w).alias("now"), F.array_append(a["out"], F.array_join(a["now"], " ")).alias("out"))).otherwise(
            F.struct((a["used"] + cost).alias("used"), F.array_append(a["now"], w).alias("now"), a["out"].alias("out"))
        )

    return F.aggregate(words, zero, step, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["out"], F.array_join(a["now"], " "))).otherwise(a["out"]))


def preview(text: Column, size: int, mark: str = "...") -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(mark))).otherwise(text)


def quality_bucket(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 0.8, "High").when(s >= 0.6, "Medium").otherwise("Low")


def quality_color(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 0.8, "green").when(s >= 0.6, "orange").otherwise("red")


def time_ago(seconds: Column) -> Column:
    """Age in whole days, else hours (over 3600 s), else minutes (over 60 s)."""
    named = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    days, rest = F.floor(seconds / 86400).cast("long"), F.pmod(seconds, F.lit(86400).cast("long"))
    return F.when(days > 0, named(days, "day")).when(rest > 3600, named(F.floor(rest / 3600).cast("long"), "hour")).when(rest > 60, named(F.floor(rest / 60).cast("long"), "minute")).otherwise("Just now")


def doc_url(client: Column, slug_url: Column) -> Column:
    """/client/docs/path#anchor with the path percent-encoded; an empty slug gives an empty link."""
    path, anchor = F.regexp_replace(F.substring_index(slug_url, "#", 1), "^/+", ""), F.regexp_extract(slug_url, "(?s)#(.*)$", 1)
    coded = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    link = F.concat(F.lit("/"), client, F.lit("/docs/"), coded, F.when(anchor == "", "").otherwise(F.concat(F.lit("#"), anchor)))
    return F.when(F.coalesce(slug_url, F.lit("")) == "", "").otherwise(link)


def split_sentences(text: Column, size: int, overlap: int) -> Column:
    """Pieces of at most `size` estimated tokens made of whole sentences; the last sentences of a piece that fit `overlap` tokens open the
    next one. A longer sentence is a piece of its own."""
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")
    cost = lambda x: F.greatest(F.lit(1), F.floor(F.char_length(x) / 4).cast("long"))
    none = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).cast("long").alias("used"), none.alias("now"), none.alias("out"))

    def tail(now: Column) -> Column:
        """The last sentences within the overlap."""
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), none.alias("kept"))

        def back(a: Column, x: Column) -> Column:
            stop = a["full"] | (a["used"] + cost(x) > overlap)
            return F.struct(F.when(stop, a["used"]).otherwise(a["used"] + cost(x)).alias("used"), stop.alias("full"), F.when(stop, a["kept"]).otherwise(F.concat(F.array(x), a["kept"])).alias("kept"))

        return F.aggregate(F.reverse(now), start, back, lambda a: F.struct(a["used"], a["kept"]))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["now"]) > 0) & (a["used"] + cost(x) > size)
        kept = tail(a["now"])
        fits = kept["used"] + cost(x) <= size
        return F.when(full, F.struct((F.when(fits, kept["used"]).otherwise(0) + cost(x)).alias("used"), F.array_append(F.when(fits, kept["kept"]).otherwise(none), x).alias("now"), F.array_append(a["out"], F.array_join(a["now"], " ")).alias("out"))).otherwise(
            F.struct((a["used"] + cost(x)).alias("used"), F.array_append(a["now"], x).alias("now"), a["out"].alias("out"))
        )

    return F.aggregate(sentences, zero, step, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["out"], F.array_join(a["now"], " "))).otherwise(a["out"]))


def is_callout(title: Column, names: tuple[str, ...] = L.CALLOUTS) -> Column:
    """Whether a title names a callout, or holds such a name."""
    low = F.lower(collapse(title))
    return reduce(or_, (low.contains(n) for n in names))


def record_books(text: Column) -> Column:
    """The three spellings of the form NP 133C, if the text names it."""
    return F.when(text.rlike(r"(?i)\bNP\s*-?\s*133C\b"), F.array(*map(F.lit, ("NP 133C", "NP133C", "NP-133C")))).otherwise(F.array().cast("array<string>"))


def stable_distinct(values: Column) -> Column:
    """Each value once, where it comes first."""
    return F.array_distinct(values)


def joined_tags(old: Column, new: Column) -> Column:
    """Comma-separated tags with new ones, sorted, each once; without new ones as they were."""
    have = F.filter(F.split(F.coalesce(old, F.lit("")), ","), lambda x: x != "")
    return F.when(F.size(new) > 0, F.array_join(F.array_sort(F.array_union(have, new)), ",")).otherwise(old)


def listed(values: Column) -> Column:
    """A list as JSON text; null if it's empty."""
    return F.when(F.size(values) > 0, F.to_json(values))


def decoded(text: Column, schema: str) -> Column:
    """struct<value, raw>: JSON text as `schema`, or, if it isn't that, as the text it is."""
    valid = F.get_json_object(text, "$").isNotNull()
    return F.struct(F.when(valid, F.from_json(text, schema)).alias("value"), F.when(~valid, text).alias("raw"))


def card(answer: Column, comment: Column) -> Column:
    """struct<answer, comment> of a feedback card: 200 characters of the answer, 500 of the comment."""
    return F.struct(preview(answer, 200).alias("answer"), F.left(F.nullif(F.trim(comment), F.lit("")), F.lit(500)).alias("comment"))


def message_id(answer: Column) -> Column:
    """Id of an answer's first 50 characters: base64 without signs, 16 characters at most."""
    return F.left(F.regexp_replace(F.base64(F.left(answer, F.lit(50)).cast("binary")), "[^A-Za-z0-9]", ""), F.lit(16))


def highlight(text: Column, markers: tuple[str, ...] = L.MARKERS) -> Column:
    """Section names at the start of a line become banners."""
    out = text
    for m in markers:
        for tail in ("\n", ":", " "):
            out = F.replace(out, F.lit(f"\n{m}{tail}"), F.lit(f"\n\n🔹 SECTION: {m.upper()} 🔹\n"))
    return out


def section_score(text: Column, sections: tuple[str, ...]) -> Column:
    """Ten for each section name with a line of under 50 characters, five for others found anywhere."""
    low = F.lower(text)
    lines = F.split(low, "\n")
    total = F.lit(0)
    for s in sections:
        total = total + F.when(~low.contains(s), 0).when(_short(lines, s), 10).otherwise(5)
    return total


def _short(lines: Column, section: str) -> Column:
    return F.exists(lines, lambda x: x.contains(section) & (F.char_length(F.trim(x)) < 50))


def extract_section(text: Column, target: str, markers: tuple[str, ...] = L.END_MARKERS) -> Column:
    """The lines from the last one that names the target before another marker, up to that marker; or null."""
    lines = F.split(text, "\n")
    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        t = F.trim(x)
        open_ = a["end"] < 0
        hit = F.lower(t).contains(target.lower())
        stop = (a["start"] >= 0) & ~hit & t.rlike("|".join(m.replace("&", r"\&") for m in markers)) & ~t.rlike(r"^[*\-•·]")
        return F.struct(F.when(open_ & hit, a["i"]).otherwise(a["start"]).alias("start"), F.when(open_ & stop, a["i"]).otherwise(a["end"]).alias("end"), (a["i"] + 1).alias("i"))

    def cut(a: Column) -> Column:
        end = F.when(a["end"] < 0, a["i"]).otherwise(a["end"])
        return F.when(a["start"] >= 0, F.trim(F.array_join(F.slice(lines, a["start"] + 1, F.greatest(F.lit(0), end - a["start"])), "\n")))

    return F.aggregate(lines, zero, step, cut)
