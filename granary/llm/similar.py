"""Near-duplicates by the similarity of their word shingles.

Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles is at least
`least`; a document's class is all that is reachable. Every link is decided by the whole shingle sets (as
64-bit hashes); candidates come in two steps:

1. SimHash: fingerprints of the shingle sets, compared bit-sliced (`simhash.links`). What is within its
   four bits and similar enough is linked; pairs in one class need no further look.
2. Minimum hashes, for what four bits don't reach (at a similarity of 0.8 about ten differ): pairs that share a
   band of `ROWS` of `BANDS * ROWS` minimum hashes (at 0.8, 5 pairs in 10^8 share none) and agree in as many of them
   as all but 5 in 10^8 linked pairs do. A pair is judged in the first band it shares.

Texts of equal words are one node. Buckets of a band are compared inside a task, on a byte a minimum hash; those over
`CHUNK` nodes are dealt out as pairs of chunks. A task returns a row a node with its candidates, gets these nodes'
texts in the same buckets, and returns links, none between nodes that it has already joined. So rows follow the
nodes, not the pairs, however large a group of copies is, and no candidate is left out.

Null and empty texts are one node. Fewer than `width` words: the whole sequence is the one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, components, discard, free_name, numbered, stored
from .simhash import links, majority

BANDS, ROWS = 32, 4
CHUNK = 1024
#: Rows of buckets compared at once, and the share of linked pairs that the agreement of minimum hashes may miss.
HELD, MISSED = 50_000, 5e-8
_RANDOM = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_FLIP, _FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of `BANDS * ROWS` minimum hashes for each set."""
    h, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat((h ^ flip) * factor, first) for flip, factor in zip(_FLIP, _FACTOR, strict=True)], axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A row of `BANDS` keys for each row of minimum hashes."""
    data = np.ascontiguousarray(least).view(np.uint8).reshape(len(least), BANDS, ROWS * 8)
    return np.array([[xxhash.xxh3_64_intdigest(data[k, b].tobytes(), b) for b in range(BANDS)] for k in range(len(least))], np.uint64).view(np.int64)


def least_agreeing(least: float) -> int:
    """The minimum hashes that all but `MISSED` of the pairs with a similarity of `least` agree in."""
    n, below = BANDS * ROWS, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * least**k * (1 - least) ** (n - k)
        if below > MISSED:
            return k
    return n


def candidates(bucket: np.ndarray, key: np.ndarray, off: np.ndarray, own: np.ndarray, root: np.ndarray, keys: np.ndarray, marks: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in one bucket (sorted) and different classes, at least `agree` of whose marks are equal and whose first
    equal key is the bucket's. off: of a bucket of two chunks, where only pairs across them count."""
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    most = int(np.diff(np.append(first, len(bucket))).max())
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for lag in range(1, most):
        x = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & (root[lag:] != root[:-lag]) & (~off[lag:] | (own[lag:] != own[:-lag])))
        x = x[(marks[x] == marks[x + lag]).sum(axis=1) >= agree]
        if len(x):
            x = x[keys[x, np.argmax(keys[x] == keys[x + lag], axis=1)] == key[x]]
            a.append(x)
            b.append(x + lag)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compared(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """(bucket, key, off, own, node, root, halves, marks) sorted by bucket -> (bucket, node, root, with): the nodes that have or are
    candidates."""

    def out(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        bucket, key, off, own, node, root, keys, marks = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b = candidates(bucket, key, off, own, root, keys, marks, agree)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        places = np.union1d(a, b)
        ends = np.searchsorted(a, places, "right")
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(node[b]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[places]), pa.array(node[places]), pa.array(root[places]), partners], names=["bucket", "node", "root", "with"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        plain = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
        wide = [np.frombuffer(b"".join(c.to_pylist()), kind).reshape(batch.num_rows, -1) for c, kind in zip(batch.columns[6:], ("<u4", "u1"), strict=True)]
        new = [plain[0], plain[1].astype(np.uint32), *plain[2:], *wide]
        # A bucket stays whole: what goes out ends where one does.
        cut = int(np.flatnonzero(new[0] == new[0][-1])[0])
        if held and sum(len(x[0]) for x in held) >= HELD and (cut or held[-1][0][-1] != new[0][0]):
            held.append([x[:cut] for x in new])
            yield out(held)
            held, new = [], [x[cut:] for x in new]
        held.append(new)
    if held:
        yield out(held)


def _linked(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """(bucket, node, root, with, text) sorted by bucket -> (a, b): links that join what all links within a bucket do."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        sets = {node: shingles(words_of(text), width) for _, node, _, _, text in rows}
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        # A class may have the name of one of its nodes; other nodes go by their own.
        name = {node: top(root) for _, node, root, _, _ in rows}
        a, b = [], []
        for _, node, _, partners, _ in rows:
            for other in partners:
                x, y = top(name[node]), top(name[other])
                if x != y and jaccard(sets[node], sets[other]) >= least:
                    up[x] = y
                    a.append(node)
                    b.append(other)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield out(held)
                held = []
            held.append(row)
    if held:
        yield out(held)


def classes(docs: DataFrame, width: int, least: float, row: str | None = None) -> DataFrame:
    """documents -> (__row, doc_id, root), one row for each row of docs. row: a stored column that numbers them."""
    rows = numbered(docs.select("doc_id", "text"), tag="similar-rows") if row is None else docs
    rows = rows.select(F.col(row or ROW).alias(ROW), "doc_id", "text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                words = [words_of(t.as_py()) for t in part.column(2)]
                node = np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 7) for w in words], np.uint64).view(np.int64)
                sets = [shingles(w, width) for w in words]
                low = least_hashes(sets)
                fp = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
                keys = band_keys(low)
                halves, marks = ([x.tobytes() for x in y] for y in (keys.astype("<u4"), low.astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), pa.array(fp), pa.array(list(keys), pa.list_(pa.int64())), pa.array(halves, pa.binary()), pa.array(marks, pa.binary())], names=[ROW, "doc_id", "node", "fp", "keys", "halves", "marks"])

    # One pass over the texts: a number for each sequence of words, its fingerprint, band keys, half of each, and a byte of each minimum hash.
    found_in = stored(rows.mapInArrow(scanned, f"{ROW} long, doc_id {dict(docs.dtypes)['doc_id']}, node long, fp long, keys array<bigint>, halves binary, marks binary"), "similar-nodes")
    nodes = found_in.select(ROW, "doc_id", "node")
    firsts = found_in.groupBy("node").agg(F.min(ROW).alias(ROW))
    each = stored(found_in.select(ROW, "node", "fp", "keys", "halves", "marks").join(firsts, [ROW, "node"], "left_semi"), "similar-each")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard(*(shingles(words_of(t.as_py()), width) for t in pair)) >= least for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    def texts(asked: DataFrame) -> DataFrame:
        """(node, text) for each node of asked."""
        return rows.join(each.select(ROW, "node").join(asked.select("node").distinct(), "node", "left_semi"), ROW).select("node", "text")

    prints = stored(each.groupBy("fp").agg(F.min("node").alias("first")), "similar-prints")
    other = prints.select(F.col("fp").alias("b"), F.col("first").alias("second"))
    near = links(prints.select("fp")).distinct().join(prints.withColumnRenamed("fp", "a"), "a").join(other, "b").select(F.col("first").alias("a"), F.col("second").alias("b"))
    equal = each.select("node", "fp").join(prints, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = stored(near.unionByName(equal), "similar-pairs")
    asked = stored(texts(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "similar-texts")
    both = pairs.join(asked.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(asked.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    star = stored(both.select("a", "b", "x", "y").mapInArrow(judged, "a long, b long"), "similar-star")
    found = components(star, "similar-cc")
    discard(prints, pairs, asked)

    bands = each.select("node", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    shared = bands.join(buckets, "key").select("node", "key", "chunks", F.pmod(F.hash("node"), F.col("chunks")).alias("own"))
    low, high = F.least("c", "own"), F.greatest("c", "own")
    shared = shared.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    shared = shared.select("node", F.xxhash64("key", low, high).alias("bucket"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), (low < high).alias("off"), "own")
    known = each.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "halves", "marks")
    dealt = shared.join(known, "node").select("bucket", "key", "off", "own", "node", "root", "halves", "marks").repartition("bucket").sortWithinPartitions("bucket")
    agree = least_agreeing(least)
    survivors = stored(dealt.mapInArrow(lambda b: _compared(b, agree), "bucket long, node long, root long, with array<bigint>"), "similar-candidates")
    wanted = survivors.join(texts(survivors), "node").select("bucket", "node", "root", "with", "text").repartition("bucket").sortWithinPartitions("bucket")
    rest = stored(wanted.mapInArrow(lambda b: _linked(b, width, least), "a long, b long"), "similar-rest")
    found = components(star.unionByName(rest), "similar-cc")
    discard(each, survivors, star, rest)
    return nodes.join(found, "node", "left").select(ROW, "doc_id", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each class stays, the one with the smallest id (the first of repeated rows)."""
    row = free_name(docs)
    rows = numbered(docs, row, "similar-rows")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)
    keep = classes(rows, width, least, row).groupBy("root").agg(F.min(order).alias("least")).select(F.col(f"least.{ROW}").alias(row))
    return rows.join(keep, row, "left_semi").drop(row)
