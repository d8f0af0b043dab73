"""Incremental forms of the log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(timestamp, total_time_ms) -> counts by day; rows later than `late` behind the newest are dropped."""
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return rows.groupBy(F.window("timestamp", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("total_time_ms").alias("ms")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "ms")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return rows.groupBy("conversation_id", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("n")).select("conversation_id", "w.start", "w.end", "n")


def sliding_counts(stream: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts by windows that overlap; each row is in every window over its time."""
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return rows.groupBy(F.window("timestamp", size, slide).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there, then stop; the result is the in-memory table `name`."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def keep_upserted(stream: DataFrame, path: str, key: str, version: str, checkpoint: str):
    """Keep a table at `path` in step with a stream: of each key the row with the greatest version. A batch that is run again changes
    nothing. The table is two folders in turn, so a reader's files stay while the next are written."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        new = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
        before = f"{path}/{(number - 1) % 2}"
        if number:
            old = spark.read.schema(rows.schema).parquet(before)
            new = old.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
        new.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress["batchId"] if query.lastProgress else None
