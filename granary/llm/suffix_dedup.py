"""Removal of byte strings that repeat across (or within) documents.

A byte goes when a `SPAN`-byte string that covers it also starts anywhere else. Every start of such
a string (a window) belongs to one anchor: the leftmost smallest hash among its `GRAM`-byte grams.
Equal windows have equal anchors at equal distances, so windows are compared by group, a run of
starts with one anchor:

1. Each group gives a hash of all bytes under its windows and the anchor's hash. An equal group
   elsewhere makes every window a repeat; an anchor seen once makes none one. All other groups are
   open: they lie at the edges of passages.
2. Open groups are cut into steps of `STEP` starts at fixed distances from the anchor. The bytes
   common to a step's windows, if seen once, close the step; so do equal bytes under all of it.
3. What is still open, some steps at the edges of passages, is decided by the collection's Burrows-Wheeler
   transform and common prefixes (`bwt`): windows of a step share a core, so its key stands for it, and
   strings of few dozen bytes are left. They're built column by column, one symbol of each string a round,
   through sequential files of the task. Marks with more than `COLLECTION` such strings, too many for one
   collection, and strings of words, eight symbols a word, are decided by 128-bit hashes of their windows
   instead, with the same result.

Counts of hashes are sums of partial counts, so no hash, however common, meets in one task; what
a task sees of one hash leaves it as one row. Copies of a document or passage thus cost one row a task.

The transform's rounds are as many as the longest string has symbols, each of them reading all files; on
whole documents that is out of reach (see the README).

All of this holds for any `Units`: bytes in strings of `SPAN`, or words in strings of a number of words,
where a unit is a word's 64-bit hash, so white space between words may differ.

Null texts are empty. Texts under `SPAN` bytes lose nothing. Repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .common import ROW, discard, free_name, numbered, released, stored

SPAN, GRAM, STEP = 400, 32, 16
#: Strings of one collection.
COLLECTION = 50_000
#: Strings of one task, about.
TASK = 10_000
WORD_GRAM = 8
#: Words of a passage that the query reports, however few bytes they have.
PASSAGE = 51


class Units(NamedTuple):
    """What strings consist of: how many make one, how many an anchor, and the bytes of each."""

    span: int
    gram: int
    size: int

    def of(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "surrogatepass")
        if self.size == 1:
            return data
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, data.split())), ">u8").astype("<u8").tobytes()

    def hashes(self, data: bytes) -> np.ndarray:
        """A 64-bit hash of the anchor's units from each position."""
        if self.size == 1:
            return gram_hashes(np.frombuffer(data, np.uint8))
        h = np.frombuffer(data, "<u8")
        for k in (1, 2, 4):
            h = _mix(h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(h[k:]))
        return _mix(h)


BYTES = Units(SPAN, GRAM, 1)


def words(count: int) -> Units:
    return Units(count, WORD_GRAM, 8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the `GRAM` bytes from each position."""
    h = data.astype(np.uint64)
    for k in (1, 2, 4):
        h = h[:-k] | (h[k:] << np.uint64(8 * k))
    for k in (8, 16):
        h = _mix(h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(h[k:]))
    return _mix(h)


def groups(data: bytes, units: Units = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor position, anchor hash) of each run of windows with one anchor."""
    n = len(data) // units.size - units.span + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    h = units.hashes(data)
    width, least = units.span - units.gram + 1, h
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    last = np.append(first[1:] - 1, n - 1)
    # The anchor of a run's first window; where a hash occurs twice in reach, the run is cut after it.
    out: list[tuple[int, int, int]] = []
    lows, highs = first.tolist(), last.tolist()
    values = least[first]
    at = _leftmost(h, first, values, width)
    for low, high, value, anchor in zip(lows, highs, values, at.tolist(), strict=True):
        while high > anchor:
            out.append((low, anchor, anchor))
            low = anchor + 1
            anchor = low + int(np.argmax(h[low : low + width] == value))
        out.append((low, high, anchor))
    a = np.array(out, np.int64).T
    return a[0], a[1], a[2], h[a[2]]


def _leftmost(h: np.ndarray, first: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first hash equal to values[k] at or after first[k]; it is within width."""
    out = np.full(len(first), -1, np.int64)
    for k in range(0, len(first), 4096):
        f, v = first[k : k + 4096], values[k : k + 4096]
        reach = np.minimum(f[:, None] + np.arange(width)[None, :], len(h) - 1)
        out[k : k + 4096] = f + np.argmax(h[reach] == v[:, None], axis=1)
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _key(data: bytes, tag: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data, tag))


def _find(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """(__row, text) -> (__row, low, high, anchor, mark, whole)."""
    names = [ROW, "low", "high", "anchor", "mark", "whole"]
    for b in batches:
        parts: list[list[np.ndarray]] = []
        for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data, u = units.of(text.as_py()), units.size
            low, high, anchor, mark = groups(data, units)
            if len(low):
                whole = np.array([_key(data[x * u : (y + units.span) * u], 1) for x, y in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
                parts.append([np.full(len(low), row), low, high, anchor, mark.view(np.int64), whole])
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


_FOUND = f"{ROW} long, low long, high long, anchor long, mark long, whole long"


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """The values of some columns that more than one row has."""
    return rows.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1").select(*columns)


def spans(rows: DataFrame, units: Units = BYTES) -> DataFrame:
    """(__row, text) -> (__row, spans array<struct<low, high>>): starts of windows that repeat."""
    kind = "suffix" if units.size == 1 else "passages"
    groups_of = stored(rows.mapInArrow(lambda b: _find(b, units), _FOUND), f"{kind}-groups")

    def judged(found: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        """Ranges that repeat whole, and those still open; with the latter goes one of each kind that
        repeats whole and has the mark of an open one, as windows of open ranges may lie in it. Equal by both
        hashes, 128 bits. The values that repeat are stored first: so both sides of a join are plain
        shuffles, and a hot value's rows are split among tasks when the plan is adapted."""
        marks = stored(repeated(found, "mark"), f"{tag}-marks")
        # Most marks are seen once; only the others' rows are dealt by their wholes.
        again = stored(found.join(marks, "mark"), f"{tag}-again")
        wholes = stored(repeated(again, "mark", "whole").withColumn("__w", F.lit(True)), f"{tag}-wholes")
        seen = stored(again.join(wholes, ["mark", "whole"], "left"), tag)
        discard(marks, wholes, again)
        known, open_ = seen.where("__w"), seen.where("__w is null").select(ROW, "low", "high", "anchor", "mark")
        one = known.groupBy("mark", "whole").agg(F.min(F.struct(ROW, "low", "high", "anchor")).alias("r")).select("mark", "r.*")
        both = open_.unionByName(one.join(stored(open_.select("mark").distinct(), f"{tag}-open"), "mark", "left_semi"))
        return known.select(ROW, "low", "high"), both.select(ROW, "low", "high", "anchor")

    def texts(open_: DataFrame) -> DataFrame:
        lists = open_.groupBy(ROW).agg(F.collect_list(F.struct("low", "high", "anchor")).alias("ranges"))
        return rows.join(lists, ROW).select(ROW, "text", "ranges")

    known, open_ = judged(groups_of, f"{kind}-judged")
    discard(groups_of)
    # Only the bytes under open groups are needed from here on.
    pieces = stored(texts(open_).mapInArrow(lambda b: _cut_out(b, units), _PIECES), f"{kind}-open")
    steps = pieces.mapInArrow(lambda b: _open_pieces(b, STEP, units), _FOUND)
    cut = stored(steps, f"{kind}-steps")
    more, rest = judged(cut, f"{kind}-judged-steps")
    discard(cut)
    left = pieces.join(rest.withColumnsRenamed({"low": "from", "high": "to"}), [ROW, "anchor"]).where("`from` >= low and `to` <= high")
    single = left.select(ROW, F.col("from").alias("low"), F.col("to").alias("high"), "anchor", "data", F.col("low").alias("base"))
    short = stored(single.mapInArrow(lambda b: _shortened(b, units), _SHORT), f"{kind}-short")
    # A word takes eight symbols, and rounds times symbols is what the transform costs: words go by hashes.
    most = COLLECTION if units.size == 1 else 0
    hot = short.groupBy("mark").count().where(F.col("count") > most).select("mark")
    many = stored(short.join(hot, "mark", "left_semi"), f"{kind}-hot")
    # The transform takes long for its bytes, so tasks go by the number of strings; else they're coalesced by size.
    tasks = -(-short.count() // TASK) or 1
    few = short.join(hot, "mark", "left_anti").repartition(tasks, "mark").sortWithinPartitions("mark")
    last = stored(few.mapInArrow(lambda b: _transformed(b, units), _RANGES), f"{kind}-transformed")
    windows = many.mapInArrow(lambda b: _windows(b, units), f"{ROW} long, low long, mark long, whole long")
    twice = stored(repeated(windows, "mark", "whole"), f"{kind}-twice")
    hashed = windows.join(twice, ["mark", "whole"]).select(ROW, "low", F.col("low").alias("high"))
    last = last.unionByName(hashed)
    every = known.unionByName(more).unionByName(last)
    out = stored(every.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans")), f"{kind}-spans")
    discard(pieces, short, many, twice)
    return out


_PIECES = f"{ROW} long, low long, high long, anchor long, data binary"


def _cut_out(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """(__row, text, ranges) -> a row for each range with the bytes under its windows."""
    for b in batches:
        out: list[tuple] = []
        for row, text, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            data, u = units.of(text.as_py()), units.size
            out += [(row, r["low"], r["high"], r["anchor"], data[r["low"] * u : (r["high"] + units.span) * u]) for r in ranges]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.binary())], names=[ROW, "low", "high", "anchor", "data"])


def _open_pieces(batches: Iterator[pa.RecordBatch], step: int, units: Units) -> Iterator[pa.RecordBatch]:
    """Pieces -> steps (__row, low, high, anchor, mark, whole). Steps are counted back from the anchor, so
    equal windows lie in equal steps; the mark hashes the bytes that all windows of the step share."""
    span, u = units.span, units.size
    for b in batches:
        out: list[tuple] = []
        for row, low, high, anchor, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            base = low
            while low <= high:
                k = (anchor - low) // step
                begin, end = anchor - (k + 1) * step + 1, anchor - k * step
                stop = min(high, end)
                # Windows of the full step share [end, begin + span); all of it is inside any of them.
                core = data[(end - base) * u : (begin + span - base) * u]
                out.append((row, low, stop, anchor, _key(core, 1000 + k), _key(data[(low - base) * u : (stop + span - base) * u], 100_000 + anchor - low)))
                low = stop + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 6)], names=[ROW, "low", "high", "anchor", "mark", "whole"])


_SHORT = f"mark long, {ROW} long, low long, piece binary"
_RANGES = f"{ROW} long, low long, high long"


def _short_span(units: Units) -> int:
    """Bytes that tell a shortened window: those outside the core, and the core's key."""
    return (STEP - 1) * units.size + 16


def _shortened(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """(__row, low, high, anchor, data, base), a step each -> (mark, __row, low, piece): the bytes that all windows of the
    whole step share, known to be equal for equal marks, become their 128-bit key; what lies around them stays.
    So two windows of a step are equal just where their shortened strings are."""
    span, u = units.span, units.size
    for b in batches:
        out: list[tuple] = []
        for row, low, high, anchor, data, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
            k = (anchor - low) // STEP
            begin, end = anchor - (k + 1) * STEP + 1, anchor - k * STEP
            cut = lambda x, y, data=data, base=base: data[(x - base) * u : (y - base) * u]
            key = xxhash.xxh3_128_digest(cut(end, begin + span), 1000 + k)
            out.append((int.from_bytes(key[:8], "big", signed=True), row, low, cut(low, end) + key + cut(begin + span, high + span)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.binary())], names=["mark", ROW, "low", "piece"])


def _transformed(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """Shortened pieces sorted by mark -> ranges of repeated starts, from the transform and common prefixes of collections that
    hold all pieces of a mark."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        found: list[tuple] = []
        for (_, row, low, _), starts in zip(rows, repeated_starts([r[3] for r in rows], _short_span(units)), strict=True):
            at = starts[starts % units.size == 0] // units.size
            if len(at):
                new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                ends = np.append(new[1:], len(at)) - 1
                found += [(row, low + x, low + y) for x, y in zip(at[new].tolist(), at[ends].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * 3)], names=[ROW, "low", "high"])

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(held) >= COLLECTION and held[-1][0] != row[0]:
                yield out(held)
                held = []
            held.append(row)
    if held:
        yield out(held)


def _windows(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """Shortened pieces -> a row for each window, by its 128-bit hash: for marks with too many pieces for one collection."""
    size, u = _short_span(units), units.size
    for b in batches:
        out: list[tuple] = []
        for row, low, piece in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            for k in range((len(piece) - size) // u + 1):
                key = xxhash.xxh3_128_intdigest(piece[k * u : k * u + size])
                out.append((row, low + k, _signed(key >> 64), _signed(key & 0xFFFFFFFFFFFFFFFF)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], names=[ROW, "low", "mark", "whole"])


def removed_runs(found: list[dict], span: int = SPAN) -> list[tuple[int, int]]:
    """Sorted ranges of window starts -> maximal runs of removed units [begin, end)."""
    runs: list[list[int]] = []
    for s in found:
        begin, end = s["low"], s["high"] + span
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    return [(a, b) for a, b in runs]


def rest_of(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what any of the runs covers."""
    out: list[list[int]] = []
    for begin, end in sorted(runs):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def bytes_of_words(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words -> runs of bytes from the first word to the last."""
    space = np.concatenate(([True], _SPACE[np.frombuffer(data, np.uint8)], [True]))
    at = np.flatnonzero(space[1:] != space[:-1])
    return [(int(at[2 * a]), int(at[2 * b - 1])) for a, b in runs]


def with_spans(docs: DataFrame, *kinds: Units) -> DataFrame:
    """docs, and the spans of each row by each kind of units as the last columns."""
    row, names = free_name(docs), []
    rows = numbered(docs, row, "suffix-rows")
    source = rows.select(F.col(f"`{row}`").alias(ROW), "text")
    for units in kinds:
        names.append(free_name(rows, f"__spans{len(names)}"))
        rows = rows.join(spans(source, units).select(F.col(ROW).alias(row), F.col("spans").alias(names[-1])), row, "left")
        released(docs.sparkSession)
    return rows.select(*(F.col(f"`{c}`") for c in [*docs.columns, *names]))


def with_passages(data: bytes, runs: list[tuple[int, int]], passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that go with the runs of bytes and the passages, runs of words."""
    return joined_runs(runs + bytes_of_words(data, passages))


def remove_repeats(docs: DataFrame, least_words: int | None = None) -> DataFrame:
    """docs without the repeated bytes, and without passages of `least_words` words (8 or more) that repeat,
    however short. A character of which only part is left goes too; n_chars, if there, is counted anew."""
    rows = with_spans(docs, BYTES, *([] if least_words is None else [words(least_words)]))
    at, width = docs.columns.index("text"), len(docs.columns)
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, kept = list(b.columns[:width]), b.schema.names[:width]
            texts = columns[at].to_pylist()
            sizes = columns[count].to_pylist() if count is not None else []
            for k, found in enumerate(zip(*(c.to_pylist() for c in b.columns[width:]), strict=True)):
                if any(found):
                    data = texts[k].encode("utf-8", "surrogatepass")
                    runs = removed_runs(found[0] or [])
                    if least_words is not None:
                        runs = with_passages(data, runs, removed_runs(found[1] or [], least_words))
                    texts[k] = rest_of(data, runs).decode("utf-8", "ignore")
                    if sizes:
                        sizes[k] = len(texts[k])
            columns[at] = pa.array(texts, pa.string())
            if sizes:
                columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return rows.mapInArrow(run, docs.schema)


def op6_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns, and as text what is left (without the bytes of characters that were cut). These go by strings of
    `SPAN` bytes alone. Passages of `PASSAGE` words or more that repeat, many of them shorter, have columns of their own:
    n_passages, their maximal runs, and text_left, what is left of text without them."""
    rows = with_spans(docs.select("doc_id", "text"), BYTES, words(PASSAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found, more in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs, passages = removed_runs(found or []), removed_runs(more or [], PASSAGE)
                rest = rest_of(data, runs)
                kept = rest.decode("utf-8", "ignore")
                left = rest_of(data, with_passages(data, runs, passages)).decode("utf-8", "ignore") if passages else kept
                out.append((len(data), sum(y - x for x, y in runs), len(runs), hashlib.sha256(rest).hexdigest(), kept, len(passages), left))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passages", "text_left"]
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return rows.mapInArrow(run, f"{schema}, n_passages long, text_left string")
