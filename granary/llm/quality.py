"""Quality rules by distribution divergence.

Each document's character-class and common-word histograms are compared with those of its language
(all documents of the table with the same lang; null lang is a language of its own) by
Jensen-Shannon distance. The reference of a language has the shares of its character classes and
of its `COMMON` most frequent words, all the rest being one more class. A document fails where a
distance passes its limit; below `MIN_WORDS` words (characters: `MIN_CHARS`) that histogram is too
thin to judge and passes. Base counts (repeated lines, repeated 8-word windows, symbols) come
first.

Null and empty texts have no words and fail the base rule (under 20 words). Repeated rows and
repeated ids are each judged on their own. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, window_hashes

WINDOW = 8
COMMON = 24
MIN_WORDS, MIN_CHARS = 50, 200
#: Limits on the Jensen-Shannon distances (0 to 1); of documents labelled good on the 0.1 tables,
#: 99.9 % stay below 0.33 and 0.24.
MAX_WORD_DISTANCE, MAX_CHAR_DISTANCE = 0.38, 0.27
#: References of languages are broadcast up to this size; larger ones are joined by a shuffle.
BROADCAST_BYTES = 20_000_000
_SPACE = r"[\x20\x09-\x0D]+"
#: Character classes: these four, bytes beyond one a character (letters that aren't ASCII), white
#: space, and all the rest (lower-case letters in the main).
_CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\[\]\-]", r"[#*$%&|<>]")
_REST = r"[a-z\x20\x09-\x0D\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows in order."""

    def marks(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        hit = lambda j: same(j, j - 1) | same(j, j + 1)
        index = F.sequence(F.lit(0), F.size(s) - 1)
        return F.array_sort(F.transform(F.filter(index, hit), lambda j: F.get(s, j)["i"]))

    def covered(sorted_marks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + width).alias("end"), (a["n"] + width - F.greatest(F.lit(0), a["end"] - p)).alias("n"))
        return F.aggregate(sorted_marks, zero, step, lambda a: a["n"])

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, lambda s: covered(marks(s)))).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), total.cast("double")), F.lit(0.0)))


def _counted(docs: DataFrame) -> DataFrame:
    """Class counts of each text; one pass leaves the few characters that the first classes look at."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"rest": F.regexp_replace("text", _REST, ""), "n_chars": F.char_length("text").cast("long")})
    found = [F.regexp_count("rest", F.lit(p)).cast("long") for p in _CLASSES]
    wide = F.octet_length("text").cast("long") - F.col("n_chars")
    return rows.select("doc_id", "lang", "text", "n_chars", F.array(*found, wide).alias("classes"))


def _classes(counts: Column, total: Column) -> Column:
    return let(counts, lambda c: F.array_append(c, total - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))


def _light(df: DataFrame) -> DataFrame:
    """df, broadcast if its stored rows take little."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def common_words(docs: DataFrame) -> DataFrame:
    """documents -> (lang, ref_words array<string>, ref_shares): the most frequent words of all documents of a language,
    and their shares with that of all the rest."""
    text = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words(F.col("text"))).alias("word"))
    counts = text.groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    every = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    top = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= COMMON).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    part = shares(F.transform("top", lambda t: t["n"]), F.col("all"))
    return top.join(every, "lang").select("lang", F.transform("top", lambda t: t["word"]).alias("ref_words"), part.alias("part")).select(
        "lang", "ref_words", F.array_append("part", F.greatest(F.lit(0.0), 1 - F.aggregate("part", F.lit(0.0), lambda a, x: a + x))).alias("ref_shares")
    )


def measured(docs: DataFrame, common: DataFrame) -> DataFrame:
    """One pass over the texts: base counts, character classes, and the distance of the common words."""
    rows = _counted(docs).withColumn("w", words(F.col("text"))).withColumn("word_chars", F.char_length(F.array_join("w", "")).cast("long"))
    rows = rows.withColumn("h", window_hashes(F.col("w"), WINDOW)).join(common, "lang", "left")
    n = F.size("w")
    found = let(F.filter("w", lambda x: F.array_contains("ref_words", x)), lambda c: let(F.transform("ref_words", lambda r: F.size(c) - F.size(F.array_remove(c, r))), lambda k: F.array_append(k, n - F.size(c))))
    return rows.select(
        "doc_id",
        "lang",
        "n_chars",
        n.cast("long").alias("n_words"),
        "word_chars",
        F.get("classes", F.lit(3)).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("h")).alias("n_repeat_words"),
        F.when(n >= MIN_WORDS, divergence(shares(found, n), F.col("ref_shares"))).alias("word_distance"),
        _classes(F.array_append("classes", F.col("n_chars") - F.col("word_chars")), F.col("n_chars")).alias("classes"),
    )


def character_shares(rows: DataFrame) -> DataFrame:
    """Measured rows -> (lang, ref_chars): shares of the character classes over all documents of a language."""
    kinds = range(len(_CLASSES) + 3)
    sums = rows.groupBy("lang").agg(*(F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in kinds), F.sum("n_chars").alias("chars"))
    return sums.select("lang", shares(F.array(*(F.col(f"c{k}") for k in kinds)), F.col("chars")).alias("ref_chars"))


def assess(docs: DataFrame) -> DataFrame:
    """documents -> base counts, the two distances (null where the guard holds) and the verdicts."""
    common = stored(common_words(docs), "quality-words")
    rows = stored(measured(docs, _light(common)), "quality-rows")
    characters = stored(character_shares(rows), "quality-characters")
    rows = rows.join(_light(characters), "lang")
    rows = rows.withColumn("char_distance", F.when(F.col("n_chars") >= MIN_CHARS, divergence(shares(F.col("classes"), F.col("n_chars")), F.col("ref_chars"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)) | F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def op5_quality(docs: DataFrame) -> DataFrame:
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "char_distance")
