"""Identifiers, change detection and rewrites that keep tables in step with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_id(*parts: Column) -> Column:
    """sha1 of the parts joined by a bar; equal content gives equal ids."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def json_id(**fields: Column) -> Column:
    """sha256 of a JSON object with sorted keys, separators ", " and ": "."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), quoted(fields[k])) for k in sorted(fields)))
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")).cast("binary"), 256)


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (file, sha256) that are new or whose hash differs, with which of the two."""
    old = before.select("file", F.col("sha256").alias("old"))
    both = now.join(old, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("old")))
    return both.select("file", "sha256", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("change"))


def removed(now: DataFrame, before: DataFrame) -> DataFrame:
    return before.join(now, "file", "left_anti")


def replace_documents(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of documents that don't come anew, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def not_there(new: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet: what has to be embedded."""
    return new.join(there.select(key), key, "left_anti")


def upsert(path: str, new: DataFrame, key: str, partition: str) -> None:
    """Replace the partitions that `new` has rows of; others stay as they are."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def first_by_position(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, position).alias("first"), F.max_by(value, position).alias("last"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without the ids that come anew, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def to_embed(chunks: DataFrame, changed_files: DataFrame, there: DataFrame) -> DataFrame:
    """Chunks to embed: all if the collection is empty, else those of changed files."""
    if not there.limit(1).count():
        return chunks
    return chunks.join(changed_files.select("file").distinct(), "file", "left_semi")
