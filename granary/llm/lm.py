"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words, and one end for each text. Every token, bigram and trigram of the training texts of the
whole table counts, so the model grows with the corpus; no process holds all of it. N-grams are known by
56-bit hashes, words by 64-bit ones.

Texts are read once and stored as buckets of about `BUCKET` tokens: the bucket's words by hash, and its
texts as numbers of words. Each bucket asks once for each word and n-gram that it has, with its own training
counts; asks are dealt by hash, as sorted sequences in Elias-Fano manner (low bits in an array, high bits as
gaps), and summed. The answers, counts in the order of the asks, go back to the bucket, and there they are
the part of the model's trie that the bucket needs. A frequent word or n-gram costs an ask a bucket.

The trie: a level holds the last words of its n-grams, sorted by context; a monotone sequence of pointers,
Elias-Fano coded, says where each context's successors begin, and a word is searched among these alone. Each
n-gram has a quantised smoothed probability, each context a quantised weight of the order below:
P(w | c) = high(c w) + rest(c) P(w | shorter c), where high = n(c w) / (n(c) + PRIOR) and
rest = PRIOR / (n(c) + PRIOR), down to (count + 1) / (N + V + 1). Levels are written to one work file of the
task and mapped from it.

A bucket's arrays of a value a token are made and used `SLICE` tokens at a time where that can be, and the trie's
levels go to the file one by one: two tasks and the JVM share an executor's memory.

Null texts are empty: the end token alone. Null ids aren't learnt from. Repeated rows count twice.
An empty table gives no rows. A very long text is a bucket of its own.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, held_out, released, stored

MOD, REST = 7, 2
BUCKET = 2_000_000
#: Tokens that the order below is worth in each context, for bigrams and trigrams: of a grid, the best by
#: leave-one-out likelihood on the 0.1 tables (-3.18 a token; -3.64 with 4 and 2; words alone -4.12).
PRIOR = (1000.0, 2.0)
END = b"\n"  # no word has white space
LEVELS = 255
BITS = 56
#: Tokens worked on at once.
SLICE = 1 << 17


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def gram_hash(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram from its context's hash and its last word's."""
    x = parent * np.uint64(0x9E3779B97F4A7C15) + word
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def slices(n: int) -> Iterator[slice]:
    return (slice(k, k + SLICE) for k in range(0, n, SLICE))


# --- sorted sequences ---


class EliasFano:
    """A sorted sequence of integers in flat buffers: low bits in an array, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.low_bits = min(32, max(0, int(universe // max(1, self.n)).bit_length() - 1))
        kind = "<u1" if self.low_bits <= 8 else "<u2" if self.low_bits <= 16 else "<u4"
        values = values.astype(np.uint64)
        self.low = (values & np.uint64((1 << self.low_bits) - 1)).astype(kind)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros(self.n + int(universe >> self.low_bits) + 1, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.high = np.packbits(bits, bitorder="little")

    @property
    def buffers(self) -> tuple[np.ndarray, np.ndarray]:
        return self.low, self.high

    def decode(self) -> np.ndarray:
        """All values in order."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        return (high.astype(np.int64) << self.low_bits) | self.low.astype(np.int64)


def sorted_bytes(values: np.ndarray) -> bytes:
    """Sorted integers as 32 low bits each, and the gaps of what is above."""
    gaps = np.diff(values >> np.uint64(32), prepend=np.uint64(0))
    kind = next(k for k, top in ((1, 1 << 8), (2, 1 << 16), (4, 1 << 32)) if not len(gaps) or int(gaps.max()) < top)
    head = np.array([len(values), kind], "<u4").tobytes()
    return head + (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + zlib.compress(gaps.astype(f"<u{kind}").tobytes(), 1)


def sorted_values(data: bytes) -> np.ndarray:
    n, kind = np.frombuffer(data, "<u4", 2).tolist()
    gaps = np.frombuffer(zlib.decompress(memoryview(data)[8 + 4 * n :]), f"<u{kind}").astype(np.uint64)
    return (np.cumsum(gaps, dtype=np.uint64) << np.uint64(32)) | np.frombuffer(data, "<u4", n, 8).astype(np.uint64)


def count_bytes(counts: np.ndarray) -> bytes:
    """Counts, of which most are small."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return np.array([len(counts)], "<u4").tobytes() + zlib.compress(small.tobytes() + counts[small == 255].astype("<i8").tobytes(), 1)


def count_values(data: bytes) -> np.ndarray:
    n, plain = int(np.frombuffer(data, "<u4", 1)[0]), zlib.decompress(memoryview(data)[4:])
    out = np.frombuffer(plain, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(plain, "<i8", -1, n)
    return out


def plane_bytes(values: np.ndarray) -> bytes:
    """Integers of which small ones are frequent: each byte of them compressed apart."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zlib.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def plane_values(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


# --- buckets ---

_BUCKET = "bucket long, held binary, lengths binary, vocabulary binary, ids binary"


def _buckets(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, learn, text) -> a row a bucket: its texts' ids, flags (1 held out, 2 learnt from) and lengths,
    its words' hashes as they come up, and each token's number among these."""
    task, number = TaskContext.get().partitionId(), 0
    docs: list = []
    flags: list[int] = []
    lengths: list[int] = []
    numbers: dict[bytes, int] = {}
    parts: list[np.ndarray] = []
    size = 0
    given_back()

    def out() -> pa.RecordBatch:
        nonlocal number
        h = np.fromiter(map(word_hash, numbers), "<u8", len(numbers))
        number += 1
        values = [[(task << 32) | (number - 1)], [docs], [bytes(flags)], [np.array(lengths, "<u4").tobytes()], [h.tobytes()], [plane_bytes(np.concatenate(parts))]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    for b in batches:
        for doc_id, held, learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            own = tokens(text.as_py())
            if size and size + len(own) > BUCKET:
                yield out()
                docs, flags, lengths, numbers, parts, size = [], [], [], {}, [], 0
                given_back()
            add = numbers.setdefault
            parts.append(np.fromiter([add(w, len(numbers)) for w in own], np.uint32, len(own)))
            docs.append(doc_id)
            flags.append(bool(held) + 2 * bool(learn))
            lengths.append(len(own))
            size += len(own)
    if size:
        yield out()


class Bucket:
    """A stored bucket's texts."""

    def __init__(self, held: bytes, lengths: bytes, vocabulary: bytes, ids: bytes):
        flags = np.frombuffer(held, np.uint8)
        self.held, self.lengths = (flags & 1).astype(bool), np.frombuffer(lengths, "<u4").astype(np.int64)
        words = np.frombuffer(vocabulary, "<u8")
        order = np.argsort(words)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        #: The words by hash, and each token's place among them.
        self.vocabulary, self.ids = words[order], place[plane_values(ids)]
        self.first = np.cumsum(np.append(0, self.lengths[:-1])) if len(self.lengths) else self.lengths
        self.learn = np.repeat(flags >> 1, self.lengths).astype(bool)
        #: Places that have one token before them in their text, and those that have two.
        inner = np.ones(len(self.ids), bool)
        inner[self.first] = False
        self.two = np.flatnonzero(inner).astype(np.int32)
        inner[self.first[self.lengths > 1] + 1] = False
        self.three = np.flatnonzero(inner).astype(np.int32)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the bigrams that end at each place of `two`, and of the trigrams of `three`."""
        h, cut = self.vocabulary[self.ids], np.uint64(64 - BITS)
        pair, triple = np.zeros(len(h), np.uint64), np.empty(len(self.three), np.uint64)
        for k in slices(len(self.two)):
            at = self.two[k]
            pair[at] = gram_hash(h[at - 1], h[at])
        for k in slices(len(self.three)):
            at = self.three[k]
            triple[k] = gram_hash(pair[at - 1], h[at]) >> cut
        del h
        pair = pair[self.two]
        pair >>= cut
        return pair, triple

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams, distinct and sorted, and how often each occurs in training texts."""
        both, one = np.concatenate(self.grams()), np.uint64(1)
        both <<= one
        both |= np.concatenate((self.learn[self.two], self.learn[self.three]))
        both.sort()
        learnt = (both & one).astype(np.uint8)
        both >>= one
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        return both[first], np.add.reduceat(learnt, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


# --- asks and answers ---

_ASK = "part long, bucket long, words binary, word_counts binary, grams binary, gram_counts binary"
_ANSWER = "part long, bucket long, words binary, grams binary, kinds long, total long"


def _cuts(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part of a sorted sequence begins; parts go by the highest bits."""
    edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(bits - parts.bit_length() + 1)
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def _asks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for bucket, *fields in zip(*(c.to_pylist() for c in b.columns), strict=True):
            given_back()
            own = Bucket(*fields)
            words, n_words = own.vocabulary, np.bincount(own.ids[own.learn], minlength=len(own.vocabulary))
            grams, n_grams = own.asked()
            w, g = _cuts(words, 64, parts), _cuts(grams, BITS, parts)
            out: list[list] = [[] for _ in range(6)]
            for p in range(parts):
                if w[p] < w[p + 1] or g[p] < g[p + 1]:
                    rows = (p, bucket, sorted_bytes(words[w[p] : w[p + 1]]), count_bytes(n_words[w[p] : w[p + 1]]), sorted_bytes(grams[g[p] : g[p + 1]]), count_bytes(n_grams[g[p] : g[p + 1]]))
                    for column, value in zip(out, rows, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])], names=["part", "bucket", "words", "word_counts", "grams", "gram_counts"])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each ask's total over all that ask the same, and the totals of the distinct ones."""
    sizes = [len(k) for k in keys]
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    total = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    back = np.empty(len(every), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    return np.split(back, np.cumsum(sizes)[:-1]), total


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asks sorted by part -> their answers; the first of each part also says how many words training texts have there."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        words, types = _summed([sorted_values(r[2]) for r in rows], [count_values(r[3]) for r in rows])
        grams, _ = _summed([sorted_values(r[4]) for r in rows], [count_values(r[5]) for r in rows])
        kinds, totals = [0] * len(rows), [0] * len(rows)
        kinds[0], totals[0] = int((types > 0).sum()), int(types.sum())
        columns = [[r[0] for r in rows], [r[1] for r in rows], list(map(count_bytes, words)), list(map(count_bytes, grams)), kinds, totals]
        types_ = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types_, strict=True)], names=["part", "bucket", "words", "grams", "kinds", "total"])

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield out(held)
                held = []
            held.append(row)
    if held:
        yield out(held)


# --- the trie ---


def quantised(p: np.ndarray) -> np.ndarray:
    """Shares in (0, 1] as bytes on a log scale; 0 stays 0."""
    return np.where(p > 0, np.clip(np.rint(LEVELS + np.log10(np.maximum(p, 1e-12)) * (LEVELS - 1) / 8), 1, LEVELS), 0).astype(np.uint8)


CODE = np.concatenate(([0.0], 10.0 ** ((np.arange(1, LEVELS + 1) - LEVELS) * 8 / (LEVELS - 1))))


class Level:
    """The n-grams of one order: successors of each context, sorted, and where each context's begin."""

    def __init__(self, parents: int, parent: np.ndarray, word: np.ndarray, high: np.ndarray, rest: np.ndarray, file):
        pointers = EliasFano(np.searchsorted(parent, np.arange(parents + 1)), len(parent) + 1)
        self.parents, self.n, self.low_bits = parents, len(parent), pointers.low_bits
        self.parts = []
        for array in (*pointers.buffers, word.astype("<u4"), high, rest):
            at = (file.tell() + 7) // 8 * 8
            file.seek(at)
            file.write(np.ascontiguousarray(array).tobytes())
            self.parts.append((at, array.dtype if array is not word else np.dtype("<u4"), len(array)))

    def mapped(self, path: str) -> None:
        """From here on the buffers come from the file."""
        low, high_bits, self.word, self.high, self.rest = (np.asarray(np.memmap(path, dtype, "r", at, n)) if n else np.zeros(0, dtype) for at, dtype, n in self.parts)
        pointers = EliasFano.__new__(EliasFano)
        pointers.n, pointers.low_bits, pointers.low, pointers.high = self.parents + 1, self.low_bits, low, high_bits
        self.begin = pointers.decode()

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of each (context, word), -1 where the context has no such successor."""
        out = np.full(len(parent), -1, np.int64)
        if not self.n:
            return out
        lo, hi = self.begin[parent], self.begin[parent + 1]
        open_ = np.flatnonzero(lo < hi)
        lo, hi, asked = lo[open_], hi[open_], word[open_]
        while len(open_):
            mid = (lo + hi) >> 1
            there = self.word[mid]
            hit = there == asked
            out[open_[hit]] = mid[hit]
            less = there < asked
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            more = np.flatnonzero((lo < hi) & ~hit)
            open_, lo, hi, asked = open_[more], lo[more], hi[more], asked[more]
        return out


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place among the sorted distinct ones, and where each of these occurs once."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    del s
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return place, order[new]


def _counted(own: Bucket, grams: np.ndarray) -> np.ndarray:
    """The count of the bigram of each place of `two`, then of the trigram of each of `three`; grams: in the order of `asked`."""
    return grams[_places(np.concatenate(own.grams()))[0]]


def build(own: Bucket, words: np.ndarray, grams: np.ndarray) -> Iterator[tuple]:
    """What the levels of a bucket's trie hold, (contexts, context, word, high, rest of each context) an order, from
    the counts of its words and of its n-grams in the order of `asked`."""
    counts = _counted(own, grams)
    width = np.int64(max(1, len(own.vocabulary)))
    context, parent = words, own.ids
    for prior, places, count in zip(PRIOR, (own.two, own.three), (counts[: len(own.two)], counts[len(own.two) :]), strict=True):
        # Where the context isn't known, nothing that follows it is.
        known = np.flatnonzero((parent[places - 1] >= 0) & (count > 0))
        at, count = places[known], count[known]
        del known
        keys = parent[at - 1] * width
        keys += own.ids[at]
        node, first = _places(keys)
        n, keys = count[first], keys[first]
        parent = np.full(len(own.ids), -1, np.int32)
        parent[at] = node
        del at, count, node, first
        above, word = (keys // width).astype(np.int32), (keys % width).astype(np.uint32)
        del keys
        high = np.empty(len(n), np.uint8)
        for k in slices(len(n)):
            high[k] = quantised(n[k] / (context[above[k]] + prior))
        rest = np.empty(len(context), np.uint8)
        for k in slices(len(context)):
            rest[k] = quantised(prior / (context[k] + prior))
        yield len(context), above, word, high, rest
        context = n


class Trie:
    """A bucket's part of the model, its levels mapped from a work file of the task."""

    def __init__(self, levels: Iterable[tuple], folder: str | None = None):
        self.file = tempfile.NamedTemporaryFile(dir=folder)  # noqa: SIM115
        self.levels = [Level(*x, self.file) for x in levels]
        self.file.flush()
        for level in self.levels:
            level.mapped(self.file.name)

    def close(self) -> None:
        self.levels = []
        self.file.close()

    def probabilities(self, own: Bucket, base: np.ndarray) -> np.ndarray:
        """P of each token given those before it; base: its probability without context."""
        p, context = base.copy(), own.ids
        for places, level in zip((own.two, own.three), self.levels, strict=True):
            nodes = np.full(len(own.ids), -1, np.int32)
            for k in slices(len(places)):
                at = places[k]
                before = context[at - 1]
                at, before = at[before >= 0], before[before >= 0]
                node = level.find(before, own.ids[at])
                own_part = np.where(node >= 0, CODE[level.high[np.maximum(node, 0)]] if level.n else 0.0, 0.0)
                p[at] = own_part + CODE[level.rest[before]] * p[at]
                nodes[at] = node
            context = nodes
        return p


# --- scoring ---


def parts_of(buckets: int) -> int:
    """Parts that asks are dealt into: a power of two that grows with the square root of the buckets, so that both
    an ask's pieces and the asks of one part stay of moderate size."""
    return 1 << max(8, int(np.ceil(np.log2(128 * max(1, buckets) ** 0.5))))


def score(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out("doc_id", MOD, REST).alias("held_out"), "text")
    rows = rows.select("doc_id", "held_out", (F.col("doc_id").isNotNull() & ~F.col("held_out")).alias("learn"), "text")
    head, tail = _BUCKET.split(", ", 1)
    ids = pa.array([], pa.int64()).type if kind in ("bigint", "long") else {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())
    schema = pa.schema([("bucket", pa.int64()), ("docs", pa.list_(ids)), *((c, pa.binary()) for c in ("held", "lengths", "vocabulary", "ids"))])
    buckets = stored(rows.mapInArrow(lambda b: _buckets(b, schema), f"{head}, docs array<{kind}>, {tail}"), "lm-buckets")
    parts = parts_of(buckets.count())
    texts = buckets.select("bucket", "held", "lengths", "vocabulary", "ids")
    asks = texts.mapInArrow(lambda b: _asks(b, parts), _ASK).repartition("part").sortWithinPartitions("part")
    answers = stored(asks.mapInArrow(_answers, _ANSWER), "lm-answers")
    del asks
    released(docs.sparkSession)
    total = answers.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    n_all, base = total["n"], float(total["n"] + total["v"] + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        given_back()
        right = right.sort_by("part")
        words, grams = (np.concatenate([count_values(x.as_py()) for x in right.column(c)]) for c in ("words", "grams"))
        del right
        for docs_, *fields in zip(*(left.column(c).to_pylist() for c in ("docs", "held", "lengths", "vocabulary", "ids")), strict=True):
            own = Bucket(*fields)
            trie = Trie(build(own, words, grams))
            c = words[own.ids]
            p = (c + 1) / base
            columns = [docs_, own.held, own.lengths, np.add.reduceat((c > 0).astype(np.int64), own.first), np.full(len(docs_), n_all), np.add.reduceat(np.log10(p), own.first), np.add.reduceat(np.log10(trie.probabilities(own, p)), own.first)]
            trie.close()
            for have, new in zip(out, columns, strict=True):
                have.extend(new if isinstance(new, list) else new.tolist())
        kinds = (ids, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    made = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return buckets.groupBy("bucket").cogroup(answers.select("bucket", "part", "words", "grams").groupBy("bucket")).applyInArrow(run, made)


def op10_lm(docs: DataFrame) -> DataFrame:
    return score(docs)
