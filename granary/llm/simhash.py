"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within `RADIUS` bits are linked; a document's class is the smallest id reachable.
Candidates: 64 bits in six blocks; two fingerprints that differ in at most four bits agree on two
whole blocks at least, so the fifteen pairs of blocks give fifteen tables of exact keys and no
link is missed. Small buckets are compared at each lag in one vector; larger ones are stored as
vertical bit planes, where carry-save counters add the differences of 64 fingerprints a word and
blocks are abandoned once all their counters pass the radius. Buckets over `CHUNK` distinct
fingerprints are dealt out as pairs of chunks, so no task holds an unbounded one. Equal
fingerprints are one node throughout.

Null and empty text: fingerprint zero, linked like any other. Fewer than four words: the whole
sequence is the one shingle. Null ids: fingerprinted and linked, but never name a class unless
it has no other id (then component_id is null). Repeated rows: each is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, components, free_name, numbered, stored

WIDTH, SEED, RADIUS = 4, 42, 4
CHUNK = 2048
SMALL = 48
#: Bit offset and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TABLES = tuple(combinations(range(6), 2))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < WIDTH:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - WIDTH + 1].tolist()
        hashes = [hash64(joined[a:b], SEED) for a, b in zip(starts, ends[WIDTH - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=[ROW, "doc_id", "fp"])


class Planes:
    """Fingerprints as 64 vertical bit planes, in blocks of 1024."""

    WORDS = 16

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        blocks = -(-self.n // (64 * self.WORDS))
        padded = np.zeros(blocks * 64 * self.WORDS, np.uint64)
        padded[: self.n] = fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64).reshape(64, blocks, self.WORDS)
        self.blocks = blocks

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, element index) of all pairs at most `radius` (under 8) bits apart."""
        q = np.repeat(np.arange(len(queries)), self.blocks)
        blk = np.tile(np.arange(self.blocks), len(queries))
        one, two, four, over = (np.zeros((len(q), self.WORDS), np.uint64) for _ in range(4))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        far = over
        for p in range(64):
            flip = np.where((queries >> np.uint64(p)) & np.uint64(1), full, np.uint64(0))
            carry = self.planes[p][blk] ^ flip[q][:, None]
            one, carry = one ^ carry, one & carry
            two, carry = two ^ carry, two & carry
            four, carry = four ^ carry, four & carry
            over = over | carry
            if p % 8 == 7:
                far = over
                planes = (one, two, four)
                equal = full
                for k in (2, 1, 0):  # counter > radius, from the highest bit down
                    if radius >> k & 1:
                        equal = equal & planes[k]
                    else:
                        far = far | (equal & planes[k])
                        equal = equal & ~planes[k]
                keep = (far != full).any(axis=1)
                if not keep.all():
                    q, blk, one, two, four, over, far = (x[keep] for x in (q, blk, one, two, four, over, far))
                    if not len(q):
                        break
        hit = np.unpackbits(np.ascontiguousarray(~far).view(np.uint8), axis=1, bitorder="little") if len(q) else np.zeros((0, 1), np.uint8)
        row, col = np.nonzero(hit)
        at = blk[row] * 64 * self.WORDS + col
        ok = at < self.n
        return q[row][ok], at[ok]


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-label components after adding the links a-b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        label = _find(parent)[label]


def bucket_edges(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect distinct `fps` just as all links up to `radius` do: two in one
    component already need no comparison, so only those outside the largest one are asked."""
    planes, label, asked = Planes(fps), np.arange(len(fps)), np.zeros(len(fps), bool)
    while True:
        largest = np.bincount(label, minlength=len(fps)).argmax()
        rest = np.flatnonzero(~asked & (label != largest)) if asked.any() else np.arange(len(fps))
        if not len(rest) or (label == label[0]).all():
            break
        asks = rest[:64]
        asked[asks] = True
        q, at = planes.near(fps[asks], radius)
        label = _merge(label, asks[q], at)
    far = np.flatnonzero(label != np.arange(len(fps)))
    return fps[far], fps[label[far]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, part, fp) sorted by the first three: edges within each bucket."""

    def edges(bucket: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(first, len(bucket)))
        out_a, out_b = [], []
        big = np.repeat(sizes > SMALL, sizes)
        for lag in range(1, min(SMALL, int(sizes.max()))):
            same = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & ~big[lag:])
            x, y = fps[same], fps[same + lag]
            ok = np.bitwise_count(x ^ y) <= RADIUS
            out_a.append(x[ok])
            out_b.append(y[ok])
        for k in np.flatnonzero(sizes > SMALL):
            a, b = bucket_edges(np.unique(fps[first[k] : first[k] + sizes[k]]))
            out_a.append(a)
            out_b.append(b)
        if out_a:
            a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
            pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        bucket, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if held and held[-1][0][-1] != bucket[0] and sum(len(x[0]) for x in held) > 200_000:
            yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        held.append((bucket, fps))
    if held:
        yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(nodes: DataFrame) -> DataFrame:
    """(fp) distinct -> (a, b): edges whose components are those of all links within the radius."""

    def block(k: int):
        lo, width = BLOCKS[k]
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))

    keys = [block(i) * F.lit(1 << BLOCKS[j][1]) + block(j) + F.lit(t << 24) for t, (i, j) in enumerate(TABLES)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    # One row for each bucket over the bound; buckets of distinct fingerprints, so few have that many.
    hot = rows.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).alias("chunks"))
    rows = rows.join(hot, "key", "left")
    own = F.pmod(F.hash("fp"), F.col("chunks"))
    parts = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, own) * F.col("chunks") + F.greatest(c, own))
    rows = rows.select("key", "fp", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts.cast("array<bigint>"))).alias("part"))
    dealt = rows.select(F.xxhash64("key", "part").alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """documents -> (__row, doc_id, fp, component_id), one row for each row of docs. row: a column that numbers
    the rows; without one they're numbered here, and the numbers are stored with the fingerprints."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias(ROW), F.col("doc_id").cast("long"), "text")
    fps = stored(rows.mapInArrow(_fingerprints, f"{ROW} long, doc_id long, fp long"), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp")), "simhash-cc")
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")
    return fps.join(classes, "fp")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class stays, the one with the smallest id (the first of repeated rows)."""
    row = free_name(docs)
    rows = numbered(docs, row, "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)
    keep = near_duplicates(rows, row).groupBy("root").agg(F.min(order).alias("least")).select(F.col(f"least.{ROW}").alias(row))
    return rows.join(keep, row, "left_semi").drop(row)


def op7_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
