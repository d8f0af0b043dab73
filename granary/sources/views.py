"""Log, chat and corpus views over the stored tables. `as_of` stands for the present everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

#: Questions with the wording that the lexicons know; user turns of conversations join them.
QUESTIONS = (
    "What records should be maintained for passage planning?",
    "How to conduct a fire drill and who is responsible?",
    "Summarize the passage planning document",
    "What should I enter in NP 133C and how often?",
    "Explain the SOLAS chapter on lifeboats",
    "Who keeps the log, and when?",
    "ECDIS radar gps checks by the master before departure",
    "risk assessment steps to follow; what forms CG-1234 F045",
    "overview of ISM Code section 7 for the chief officer",
    "Describe life raft and EPIRB inspection, MARPOL and MLC 2006 duties",
    "NP 133 log",
    "list of crew certificates",
    "The method of testing emergency response plans is documented where",
    "what is the procedure for boat drill on a passage plan?",
    "Tell me about the watch kept by the officer of the watch",
    "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    ms = F.floor(F.col("value") * 10).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("client_id"),
        F.col("user_id").cast("string").alias("conversation_id"),
        F.concat_ws(" ", F.lit("q"), "event_type", k.cast("string")).alias("original_query"),
        F.concat(F.repeat(F.concat(F.lit("answer "), "event_type", F.lit(" ")), (k % 25).cast("int")), k.cast("string")).alias("answer"),
        F.nullif("event_type", F.lit("signup")).alias("query_intent"),
        ms.alias("total_time_ms"),
        F.floor(ms / 2).cast("long").alias("retrieval_time_ms"),
        F.floor(ms / 5).cast("long").alias("reranking_time_ms"),
        F.floor(ms / 4).cast("long").alias("synthesis_time_ms"),
        F.when(k % 5 != 0, k / 100.0).alias("top_reference_score"),
        (k % 2 == 0).alias("is_compound"),
        (k % 7 == 0).alias("is_followup"),
        (k % 3 == 0).alias("entities_detected"),
        (k % 4 == 0).alias("was_rewritten"),
        (k / 100.0).alias("confidence_score"),
        (k % 13).cast("long").alias("chunks_retrieved"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        k.alias("k"),
    )


def query_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks 1 to k % 4 of each log, scores falling with rank."""
    logs = query_logs(spark, sf_dir).select(F.col("id").alias("query_log_id"), "k")
    refs = logs.select("query_log_id", "k", F.posexplode(F.expr("filter(sequence(1, 4), r -> r <= k % 4)")).alias("pos", "rank"))
    return refs.select("query_log_id", (F.col("pos") + 1).cast("long").alias("reference_rank"), F.concat(F.lit("Section "), (F.col("k") * F.col("rank")).cast("string")).alias("title"), F.round(F.col("k") / 100.0 / F.col("rank"), 6).alias("score"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, and one citation row at the end of each conversation."""
    c = table(spark, sf_dir, "conversations")
    at = lambda seconds: F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + seconds).cast("timestamp_ntz")
    name = F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"), F.lit(":"), F.col("conv_id").cast("string"))
    turns = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), name.alias("conversation_id"), "role", F.col("text").alias("content"), at(F.col("turn")).alias("ts"), (F.col("conv_id") % 5 == 0).alias("persistent"))
    refs = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("id"), name.alias("conversation_id"), F.lit("assistant").alias("role"), F.lit("[REFS]<ul></ul>").alias("content"), at(F.col("turn") + 1).alias("ts"), (F.col("conv_id") % 5 == 0).alias("persistent")
    )
    return turns.unionByName(refs)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    up = F.col("quality") == 1
    return q.join(d, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("client_id"), F.when(up, "thumbs_up").otherwise("thumbs_down").alias("feedback_type"), F.left("text", F.lit(300)).alias("answer"),
        F.when(~up, F.concat(F.lit("comment "), F.col("doc_id").cast("string"))).alias("comment"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).cast("timestamp_ntz").alias("created_at"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(-k, q) for k, q in enumerate(QUESTIONS, 1)], "id long, q string")
    return given.unionByName(table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("q")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, numbered within each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("client_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.select("doc_id", "client_id", F.col("pos").cast("long").alias("chunk_index"), "text")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of pages: every fifth hash altered, every eleventh row missing."""
    p = table(spark, sf_dir, "pages")
    sha = F.sha2(F.col("html").cast("binary"), 256)
    return p.where("page_id % 11 <> 0").select(F.col("url").alias("file"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), sha)).otherwise(sha).alias("sha256"))


def manual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that aren't blank, numbered from 1, each with its first three words as title."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line"))
    return d.select("doc_id", (F.col("pos") + 1).alias("i"), "line", F.array_join(F.slice(F.split(F.trim("line"), " "), 1, 3), " ").alias("title"))


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, html): each document as a page with links to bookmarks, headings of three kinds, lists, callouts and tables."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    i, title = F.col("i").cast("string"), safe(F.col("title"))
    link = F.when(F.col("i") % 4 != 0, F.concat(F.lit('<p><a href="#_Toc'), i, F.lit('">'), i, F.lit("."), title, F.lit("</a></p>"))).otherwise("")
    kind = F.col("i") % 3
    heading = (
        F.when(kind == 1, F.concat(F.lit('<h2><a name="_Toc'), i, F.lit('">'), i, F.lit(" "), title, F.lit("</a></h2>")))
        .when(kind == 2, F.concat(F.lit('<h3 id="sec'), i, F.lit('">'), i, F.lit(" "), title, F.lit("</h3>")))
        .otherwise(F.concat(F.lit('<p class="Heading2 x" id="sty'), i, F.lit('">'), title, F.lit("</p>")))
    )
    items = F.when(F.col("i") % 7 == 0, F.concat(F.lit("<ul><li>"), title, F.lit("</li><li>x</li></ul>"))).otherwise("")
    callout = F.when(F.col("i") % 4 == 0, "<div><b>Records</b> kept F042</div>").otherwise("")
    row = lambda r: F.concat(F.lit("<tr><td>"), r.cast("string"), F.lit("</td><td>"), i, F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.col("i") % 25 + 1), row), "")
    data = F.when(F.col("i") % 5 == 0, F.concat(F.lit("<table><tr><th>k</th><th>v</th></tr>"), rows, F.lit("</table>"))).otherwise("")
    body = F.concat(heading, F.lit("<p>"), safe(F.col("line")), F.lit("</p>"), items, callout, data)
    each = manual_lines(spark, sf_dir).select("doc_id", "i", link.alias("link"), body.alias("body"))
    parts = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "link", "body"))).alias("x"))
    joined = lambda name: F.array_join(F.transform("x", lambda x: x[name]), "")
    return parts.select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit("<html><body>"), joined("link"), joined("body"), F.lit("</body></html>")).alias("html"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, pos, tag, text, is_heading): lines of documents as elements of various tags."""
    i = F.col("chunk_index")
    tag = F.when(i % 7 == 1, "h2").when(i % 7 == 3, "li").when(i % 7 == 5, "ul").when(i % 11 == 0, "table").otherwise("p")
    text = F.when(i % 13 == 4, "").when(i % 6 < 2, F.concat(F.lit("HEAD "), i.cast("string"))).otherwise(F.col("text"))
    rows = chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), i.alias("pos"), tag.alias("tag"), text.alias("text"))
    return rows.withColumn("is_heading", (F.col("tag") == "h2") | ((F.col("tag") == "p") & F.endswith("text", F.lit("."))))
