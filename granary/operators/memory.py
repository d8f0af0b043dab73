"""Conversations: history, listing, search, validation and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system")


def valid(messages: DataFrame) -> DataFrame:
    """Messages with a known role and some text, trimmed."""
    text = F.trim("content")
    return messages.where(F.col("role").isin(*ROLES) & (F.coalesce(text, F.lit("")) != "")).withColumn("content", text)


def is_valid(messages: DataFrame) -> DataFrame:
    return messages.withColumn("is_valid", F.coalesce(F.col("role").isin(*ROLES), F.lit(False)) & (F.coalesce(F.trim("content"), F.lit("")) != ""))


def without_citations(messages: DataFrame) -> DataFrame:
    cited = (F.col("role") == "assistant") & F.startswith("content", F.lit("[REFS]"))
    return messages.where(~F.coalesce(cited, F.lit(False)))


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation; `turn` counts them in order of time."""
    down = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    kept = messages.withColumn("back", F.row_number().over(down)).where(F.col("back") <= n)
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")).cast("long")).drop("back")


def prompt_history(messages: DataFrame) -> DataFrame:
    """Of the last 12 the last 10, of those the non-blank, of those the last 8, as `Role: text` lines."""
    kept = last_turns(last_turns(messages, 12), 10).where(F.trim("content") != "")
    return last_turns(kept, 8).select("conversation_id", "turn", F.concat(F.initcap("role"), F.lit(": "), F.trim("content")).alias("line"))


def conversations(messages: DataFrame, prefix: str | None = None) -> DataFrame:
    rows = messages if prefix is None else messages.where(F.startswith("conversation_id", F.lit(prefix)))
    return rows.groupBy("conversation_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def search(messages: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """Newest messages that contain the needle, whatever its case; % and _ stand for themselves."""
    return messages.where(F.contains(F.lower("content"), F.lit(needle.lower()))).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def retained(messages: DataFrame, as_of: str, days: int) -> DataFrame:
    """What a clean-up keeps: persistent messages and those under `days` old."""
    return messages.where(F.col("persistent") | (F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")))


def delete_conversation(messages: DataFrame, conversation_id: str, client: str) -> DataFrame:
    """What is left; only a conversation of the client's own goes."""
    own = F.startswith(F.lit(conversation_id), F.lit(f"{client}:"))
    return messages.where(~((F.col("conversation_id") == conversation_id) & own))


def deleted_count(messages: DataFrame, conversation_id: str, client: str) -> DataFrame:
    """(deleted): how many messages a deletion removes."""
    own = F.startswith(F.lit(conversation_id), F.lit(f"{client}:"))
    return messages.agg(F.count_if((F.col("conversation_id") == conversation_id) & own).alias("deleted"))


def in_order(messages: DataFrame, conversation_id: str) -> DataFrame:
    """A conversation without its citations, by id."""
    return without_citations(messages.where(F.col("conversation_id") == conversation_id)).orderBy("id")


def previous_question(messages: DataFrame) -> DataFrame:
    """Each assistant message with the nearest user message before it (an as-of join on order)."""
    before = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)
    return messages.withColumn("question", asked).where("role = 'assistant'").select("id", "conversation_id", "question")
