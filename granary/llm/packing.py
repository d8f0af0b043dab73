"""Sequence packing by minimum bin slack.

Documents become token ids and an end id; whole windows are cut off first, and what remains of each
document is one item. Items of one length are alike, so the histogram of lengths (at most one entry
a length, whatever the corpus) is all the planner needs: bitset subset-sum dynamic programming
finds the multiset of lengths that fills a window exactly, counts are backtracked, and the pattern
is used as often as its lengths last. Lengths that no longer fill a window exactly are laid end to
end and cut at its edges (those documents are tokenized once more for the cut pieces), and the
last, partial window is split into powers of two. So there's no padding at all.

An item's place follows from its rank among those of its length: counts for each (bucket, length)
are summed over the buckets before, and the rank within a bucket is added. No length, however
common, meets in one task.

Null texts count as empty: a document of the end id alone. Repeated rows are packed each. Null ids
are kept. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, numbered, stored

CAPACITY = 4096
END_ID = 2
#: Words whose ids a task keeps at hand.
CACHED = 500_000
#: The vocabulary's pattern for what one run of characters is.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that are one letter, digit or sign in any version of Unicode and stay themselves when composed:
#: ASCII and Latin, but for the capital I with a dot, which is two characters in lower case.
_PLAIN = "[!-~\u00a1-\u012f\u0131-\u024f]+"
#: Cut pieces that are broadcast (about 60 bytes each); more meet their texts in a shuffled join.
BROADCAST_PIECES = 50_000


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it's printable, else the next
    free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


_LETTERS = _byte_letters()


class WordIds(dict):
    """Ids of white-space separated words as little-endian 32-bit bytes. The vocabulary drops white
    space and never joins across it, so a text's ids are those of its words in turn.

    Words of Latin letters, digits and signs are cut into runs here (`_RUNS`, the vocabulary's own pattern)
    and each distinct run meets the model once; any other word goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = regex.compile(_PLAIN)
        self.cut = regex.compile(_RUNS).findall
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            spelt = run if run.isascii() else "".join(map(_LETTERS.__getitem__, run.encode()))
            ids = self.runs[run] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED:
            self.clear()
            self.runs.clear()
        text = word.decode("utf-8", "replace")
        if self.plain.fullmatch(text) and "<|" not in text:
            low = text.lower()
            ids = self._run(low) if low.isascii() and low.isalpha() else b"".join(map(self._run, self.cut(low)))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return b"".join(map(self.__getitem__, words)) + END_ID.to_bytes(4, "little")


def tokenized(docs: DataFrame, vocabulary: str, bucket_rows: int = 2_000) -> DataFrame:
    """docs (__row, doc_id, text) -> a piece for each whole window and for what remains:
    (__row, doc_id, start, length, ids_crc32, doc_tokens, bucket, rank within bucket and length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary)
        ranks: dict[int, int] = {}
        bucket, in_bucket = None, 0
        for b in batches:
            out: list[tuple] = []
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket is None or in_bucket >= bucket_rows:
                    bucket, in_bucket, ranks = row, 0, {}  # the first row's number names its bucket
                in_bucket += 1
                ids = words.ids(text.as_py())
                total = len(ids) // 4
                for start in range(0, total, CAPACITY):
                    part = ids[4 * start : 4 * (start + CAPACITY)]
                    length = len(part) // 4
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    out.append((row, doc_id, start, length, zlib.crc32(part), total, bucket, rank))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 8)], names=[ROW, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "rank"])

    schema = f"{ROW} long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long, rank long"
    return docs.select(ROW, F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The reachable sum closest to capacity and how many of each length make it. Sums reached so
    far are the bits of one integer; each length is added in powers of two of its count, and the
    bits after each step are kept for backtracking. Stops once the capacity itself is reached."""
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            k *= 2
        if reach >> capacity & 1:
            break
    at = best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return best, used


@dataclass
class Plan:
    """For each length, ranges of ranks and where they go. A range of kind 0 holds `times` windows
    from `sequence` on, `each` items a window from `offset`; of kind 1, items end to end from `position`
    of the stream whose windows start at `stream`."""

    length: np.ndarray
    low: np.ndarray
    kind: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    stream: int
    tail: int  # position in the stream where the partial window starts, and its size
    tail_size: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = {k: v for k, v in histogram.items() if v}
    done: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0

    def use(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, each in pattern.items():
            rows.append((length, done[length], 0, sequence, offset, each))
            offset += length * each
            done[length] += each * times
            counts[length] -= each * times
        sequence += times

    if counts.get(capacity):
        use({capacity: 1}, counts[capacity])
    lengths = sorted((k for k in counts if counts[k]), reverse=True)
    while lengths:
        best, used = fill(lengths, counts, capacity)
        if best < capacity:
            break
        use(used, min(counts[k] // n for k, n in used.items()))
        lengths = [k for k in lengths if counts[k]]
    position = 0
    for length in lengths:
        rows.append((length, done[length], 1, 0, position, 1))
        position += length * counts[length]
    rows.sort(key=lambda r: (r[0], r[1]))
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    return Plan(columns[0], columns[1], columns[2], columns[3], columns[4], columns[5], sequence, position - position % capacity, position % capacity)


def place(p: Plan, length: np.ndarray, rank: np.ndarray, capacity: int = CAPACITY) -> list[np.ndarray]:
    """Items -> (item, start within it, length, sequence, offset) of each piece."""
    # Ranges are sorted by (length, low): find the last one not after (length, rank).
    code = np.searchsorted(np.unique(p.length), p.length)
    big = int(max(p.low.max(initial=0), rank.max(initial=0))) + 1
    at = np.searchsorted(code * big + p.low, np.searchsorted(np.unique(p.length), length) * big + rank, side="right") - 1
    j, each = rank - p.low[at], p.each[at]
    item = np.arange(len(length))
    whole = p.kind[at] == 0
    out = [[item[whole], np.zeros(whole.sum(), np.int64), length[whole], (p.sequence[at] + j // each)[whole], (p.offset[at] + j % each * length)[whole]]]
    begin = (p.offset[at] + j * length)[~whole]
    end, rest = begin + length[~whole], item[~whole]
    # Cuts of the stream: each window's edge, and in the partial window the powers of two.
    sizes = [1 << k for k in range(capacity.bit_length(), -1, -1) if p.tail_size >> k & 1]
    edges = p.tail + np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    while len(rest):
        inside = begin >= p.tail
        k = np.searchsorted(edges, begin, side="right") - 1
        low = np.where(inside, edges[np.minimum(k, len(edges) - 1)], begin - begin % capacity)
        high = np.where(inside, edges[np.minimum(k + 1, len(edges) - 1)], low + capacity)
        stop = np.minimum(end, high)
        number = p.stream + np.where(inside, p.tail // capacity + k, begin // capacity)
        out.append([rest, begin - (end - length[rest]), stop - begin, number, begin - low])
        more = stop < end
        rest, begin, end = rest[more], stop[more], end[more]
    return [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]


_PIECE = f"{ROW} long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut boolean"


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """documents -> pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    rows = numbered(docs.select("doc_id", "text"), tag="packing-rows")
    items = stored(tokenized(rows, vocabulary), "packing-items")
    counts = items.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = stored(counts.select("bucket", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in ahead.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length: 4096 at most
    p = plan(histogram, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, doc_id, start, length, crc, total, rank = b.columns
            item, skip, size, sequence, offset = place(p, length.to_numpy(), rank.to_numpy(), capacity)
            take = pa.array(item)
            cut = size != length.to_numpy()[item]
            yield pa.RecordBatch.from_arrays(
                [row.take(take), doc_id.take(take), pa.array(start.to_numpy()[item] + skip), pa.array(size), crc.take(take), total.take(take), pa.array(sequence), pa.array(offset), pa.array(cut)],
                names=[ROW, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"],
            )

    ranked = items.join(ahead, ["bucket", "length"]).select(ROW, "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("ahead")).alias("rank"))
    pieces = stored(ranked.mapInArrow(run, _PIECE), "packing-pieces")
    # Pieces of cut items: their documents are tokenized again for the checksums.
    n_cut = pieces.where("cut").count()
    cut = pieces.where("cut").groupBy(ROW).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    if n_cut <= BROADCAST_PIECES:
        cut = F.broadcast(cut)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary)
        for b in batches:
            out = []
            for doc_id, text, cuts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids = words.ids(text.as_py())
                for c in cuts:
                    part = ids[4 * c["start"] : 4 * (c["start"] + c["length"])]
                    out.append((doc_id, c["start"], c["length"], zlib.crc32(part), len(ids) // 4, c["sequence_id"], c["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fixed = rows.join(cut, ROW).select(F.col("doc_id").cast("long"), "text", "cuts").mapInArrow(again, ", ".join(f"{c} long" for c in columns))
    return pieces.where("not cut").select(columns).unionByName(fixed)


def op2_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
