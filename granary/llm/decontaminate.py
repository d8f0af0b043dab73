"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Each benchmark item gives its windows of `WIDTH` consecutive words; a shorter one, unless it has
no word, is one window. The 64-bit hash of every document window meets that set in one broadcast hash
join on the hash alone; only windows whose hash is there are spelt out and verified. Beyond
`BROADCAST_BYTES` of windows the same join runs as a shuffled one. Document words inside any
occurrence are hit.

Null and empty texts have no words and no hit. Repeated rows and repeated ids are each judged on
their own row. Without benchmark windows nothing is contaminated. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, free_name, numbered, stored

WIDTH = 10
#: The windows, their hashes and their items take this much at most if they're to be broadcast.
BROADCAST_BYTES = 100_000_000
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATOR), "")


def window_hash(w: Column, pos: Column, width: int) -> Column:
    """Hash of the `width` words from pos on: plain functions of a word array, so that it's compiled."""
    return F.xxhash64(*(F.get(w, pos + k) for k in range(width)))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """benchmark -> (width, h, gram, items): each distinct window, its hash, and the items that have it."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("width"), F.posexplode("w").alias("pos", "__first")).where(F.col("pos") + F.col("width") <= F.size("w"))
    h = F.coalesce(*(F.when(F.col("width") == k, window_hash(F.col("w"), F.col("pos"), k)) for k in range(1, width + 1)))
    grams = rows.select("item_id", "width", h.alias("h"), F.array_join(F.slice("w", F.col("pos") + 1, F.col("width")), " ").alias("gram"))
    return grams.groupBy("width", "h", "gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, row: str | None = None) -> DataFrame:
    """(__row, doc_id, n_words, spans array<struct<pos, width>>, items array<string>) for every row. row: a
    stored column that numbers the rows; the numbers given otherwise hold within one job only."""
    grams = stored(item_windows(benchmark, width), "benchmark-windows")
    size = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8) + 40
    sizes = {r["width"]: r["bytes"] for r in grams.groupBy("width").agg(F.sum(size).alias("bytes")).collect()}  # one row a width, `width` at most
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias(ROW), "doc_id", words(F.col("text")).alias("w"))
    # A place after the last word stands for the document itself.
    each = rows.select(ROW, "doc_id", "w", F.size("w").alias("n"), F.posexplode(F.array_append("w", F.lit(""))).alias("pos", "__first"))
    at = F.col("pos")
    kinds = [F.struct(F.lit(k).alias("width"), F.when(at + k <= F.col("n"), window_hash(F.col("w"), at, k)).alias("h")) for k in sorted(sizes)] or [F.struct(F.lit(0).alias("width"), F.lit(None).cast("long").alias("h"))]
    if len(kinds) == 1:
        found = each.select(ROW, "doc_id", "w", "n", "pos", kinds[0].alias("k")).select(ROW, "doc_id", "w", "n", "pos", "k.width", "k.h")
    else:
        found = each.select(ROW, "doc_id", "w", "n", "pos", F.inline(F.array(*kinds)))
    found = found.where(F.col("h").isNotNull() | (at == F.col("n")))
    named = grams.select(F.col("h").alias("__h"), F.col("width").alias("__width"), "gram", "items")
    text = F.array_join(F.slice("w", at + 1, F.col("width")), " ")
    # Two texts of which each starts with the other are equal; said so, it isn't taken for a join key.
    same = (F.col("width") <= F.col("__width")) & (F.col("width") >= F.col("__width")) & F.startswith(text, F.col("gram")) & F.startswith(F.col("gram"), text)
    if sum(sizes.values()) <= BROADCAST_BYTES:
        met = found.join(F.broadcast(named), (F.col("h") == F.col("__h")) & same, "left")
    else:
        # Windows alone are shuffled, and those that meet a hash are verified; documents follow from the sentinels.
        kept = found.select(ROW, "doc_id", "n", "pos", "width", "h", F.when(F.col("h").isNotNull(), text).alias("text"))
        same = (F.col("width") <= F.col("__width")) & (F.col("width") >= F.col("__width")) & F.startswith(F.col("text"), F.col("gram")) & F.startswith(F.col("gram"), F.col("text"))
        met = kept.join(named, (F.col("h") == F.col("__h")) & same, "left")
    met = met.where("items is not null or pos = n")
    span = F.when(F.col("items").isNotNull(), F.struct("pos", "width"))
    hits = met.groupBy(ROW, "doc_id", F.col("n").cast("long").alias("n_words"))
    return hits.agg(F.sort_array(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["pos"] + s["width"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["pos"] + s["width"] - F.greatest(a["end"], s["pos"]))).alias("n")
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"]).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without any benchmark window."""
    row = free_name(docs)
    rows = numbered(docs, row, "decontaminate-rows")
    hit = find_hits(rows, benchmark, width, row).where(F.size("spans") > 0).select(F.col(ROW).alias(row))
    return rows.join(hit, row, "left_anti").drop(row)


def op8_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = covered(F.col("spans"))
    return find_hits(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
