"""How queries move their rows: what is shuffled, and what one task or worker holds."""

import datetime as dt
import json
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import anchors, mining, retrieval, sections
from granary.plans.catalog import QUERIES
from granary.plans.understanding import BM25
from granary.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single)", plan(df)))


def test_pruned_patterns_shuffles_rows_of_texts_and_rare_words_alone(spark, small):
    assert exchanges(QUERIES["pruned_patterns"](spark, small)) <= 3  # counts of words, words by their text, and kept words by document
    docs = spark.createDataFrame([(1, "alpha beta alpha beta"), (1, "gamma alpha beta"), (2, None), (3, "beta delta")], "doc_id long, text string")
    got = mining.pruned(mining.best_terms(docs), mining.document_frequency(docs), max_df=2).collect()
    assert sorted((r.doc_id, r.place, r.term) for r in got) == [(1, 1, "alpha beta"), (1, 2, "gamma alpha"), (1, 3, "beta alpha"), (1, 4, "alpha"), (1, 5, "gamma"), (3, 1, "beta delta")]


def test_top_terms_shuffle_nothing(spark, small):
    assert exchanges(QUERIES["top_terms"](spark, small)) == 0


def test_rules_build_shuffles_no_terms_beyond_rare_words(spark, small):
    assert exchanges(QUERIES["rules_build"](spark, small)) <= 4


def test_section_rows_leave_a_worker_in_parts(monkeypatch):
    monkeypatch.setattr(sections, "HELD", 30)
    pages = pa.RecordBatch.from_pydict({"file": ["a", "b", "c", "d"], "html": ["<h1>x</h1><p>y</p>", "<h1>x</h1><p>y</p>", None, "<h2>z"]})
    schema = pa.schema([("file", pa.string()), ("section", pa.int64()), ("title", pa.string())])
    made = lambda file, html: [{"file": file, "section": k, "title": x["title"]} for k, x in enumerate(sections.section_tree(html))]
    parts = [b.to_pylist() for b in sections.by_page(iter([pages]), made, schema)]
    assert [[(r["file"], r["title"]) for r in p] for p in parts] == [[("a", "x"), ("b", "x")], [("c", "Document"), ("d", "z")]]


def test_section_tree_of_a_deep_page():
    found = sections.section_tree("<h2>x</h2>" + "<div>" * 5000 + "deep")
    assert found[0]["blocks"][0]["text"] == "x\n\ndeep"


def test_plain_pages_are_read_as_the_parser_reads_them():
    for page, plain in (('<H2 id="a" CLASS="b">x &amp; y</h2><p>1 &lt 2<br>z', True), ("<p>a < b", False), ("<br/>", False), ("<script><p></script>", False), ("text", True), ("", True), ('<a href="?a&amp;b">x</a>', False)):
        fast, slow = sections._Tree(), sections._Tree()
        assert fast.feed_plain(page) == plain
        slow.feed(page)
        slow.close()
        shape = lambda x: (x.tag, x.attributes, [c if isinstance(c, str) else shape(c) for c in x.children])  # noqa: B023, E731
        assert not plain or shape(fast.root) == shape(slow.root)


def test_bm25_of_repeated_and_empty_rows(spark, tmp_path):
    docs = [(1, "the red fox"), (1, "red red dog"), (1, "a longer red dog here"), (2, None), (3, ""), (4, "Fox fox"), (5, "the dog"), (6, "the dog")]
    asked = [(1, "red fox red"), (1, "fox den"), (2, "the dog"), (3, None), (4, "zz")]
    got = retrieval.bm25_topk(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", asked)
    assert sorted((r.query_id, r.doc_id, r.score, r.rank) for r in got) == sorted(con.execute(f"with {BM25} select query_id, doc_id, score, rank from bk").fetchall())
    assert len(got) > 4


@pytest.mark.parametrize("name", ["rerank_apply", "reference_build", "hybrid_rrf", "no_result_answer", "extractive_answer", "intent_reorder", "rerank_prompt", "marked_passages", "chat_sources", "citations"])
def test_passages_meet_texts_without_a_shuffle_of_words(spark, small, name):
    assert "hashpartitioning(doc_id" not in plan(QUERIES[name](spark, small))


def test_export_is_placed_in_many_tasks(spark):
    at = lambda x: x and dt.datetime.fromisoformat(x)
    times = ["2024-01-01 00:59:59", "2024-01-01 01:00:00", "2024-01-01 01:00:00", "2023-12-31 23:30:00", "1969-12-31 23:59:59", None, None]
    rows = spark.createDataFrame([(k, at(x)) for k, x in enumerate(times)], "id long, timestamp timestamp_ntz")
    out = files.exported(rows, "json")
    assert [(r.place, json.loads(r.line)["id"]) for r in out.orderBy("place").collect()] == [(1, 2), (2, 1), (3, 0), (4, 3), (5, 4), (6, 6), (7, 5)]
    assert [r.place for r in files.exported(rows, "csv").orderBy("place").collect()] == list(range(8))
    many = spark.range(2000).select("id", F.timestamp_seconds(F.col("id") * 600).alias("timestamp"))
    shares = files.exported(many, "json").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(shares) > 1


def scans(df):
    return plan(df).count("FileScan parquet")


def test_prefixes_and_titles_meet_in_one_pass(spark, small):
    assert scans(QUERIES["anchor_by_prefix"](spark, small)) == 2 and exchanges(QUERIES["anchor_by_prefix"](spark, small)) == 2
    index = [("f", "bookmark", 1, 0, "b0", "ab c"), ("f", "bookmark", 1, 1, "b1", "ab d"), ("f", "bookmark", 1, 2, "b2", "ab c"), ("f", "toc", 0, 0, "t0", "ab"), ("f", "toc", 0, 1, "t1", "x"), ("g", "toc", 0, 0, "t2", "ab c")]
    index = spark.createDataFrame(index, "file string, source string, rank int, pos long, id string, key string")
    titles = spark.createDataFrame([("f", "AB"), ("f", "ab "), ("f", "ab c"), ("f", "a"), ("f", None), ("g", "ab"), ("h", "ab"), (None, "x")], "file string, title string")
    got = {(r.file, r.title): r.anchor for r in anchors.resolve_by_prefix(titles, index).collect()}
    assert got == {("f", "AB"): "t0", ("f", "ab "): "t0", ("f", "ab c"): "b2", ("f", "a"): "sec-a", ("f", None): "sec-untitled", ("g", "ab"): "t2", ("h", "ab"): "sec-ab", (None, "x"): "sec-x"}
    assert {(r.file, r.title): r.anchor for r in anchors.resolve_by_prefix(spark.createDataFrame([("f", "ab")], titles.schema), index.where("source = 'bookmark'")).collect()} == {("f", "ab"): "b2"}


def test_toc_chunks_shuffle_pages_once(spark, small):
    assert exchanges(QUERIES["toc_chunks"](spark, small)) == 1


def test_titles_meet_anchors_in_one_pass(spark, small):
    assert scans(QUERIES["anchor_resolve"](spark, small)) == 2 and exchanges(QUERIES["anchor_resolve"](spark, small)) == 2
    index = [("f", "slug", 4, 0, "s", ""), ("f", "heading", 2, 0, "h", "k"), ("f", "bookmark", 1, 5, "b", "k"), ("f", "toc", 0, 9, "t9", "j"), ("f", "toc", 0, 2, "t2", "j")]
    titles = spark.createDataFrame([("f", "K"), ("f", "4. j"), ("f", "4."), ("f", None)], "file string, title string")
    got = anchors.resolve(titles, spark.createDataFrame(index, "file string, source string, rank int, pos long, id string, key string")).collect()
    assert {r.title: r.anchor for r in got} == {"K": "b", "4. j": "t2", "4.": "s", None: "sec-untitled"}


def test_bookmark_sections_are_cut_where_the_page_lies(spark, small):
    assert exchanges(QUERIES["bookmark_sections"](spark, small)) == 1
    texts = ["a<b", "<p>x&nbsp;y&amp;lt; &amp z</p>", "< SCRIPT a>b</ script >c<style>d</STYLE>", "\x1c a\x85b\u2003c \t", "", "<a\n>é&eacute;&#8364;", "a > b &lt; c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip_tags(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [T.stripped(r.t) for r in rows]
