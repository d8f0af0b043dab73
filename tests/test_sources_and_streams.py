"""Files in and out, incremental rewrites, and streams against their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from granary.functions import question as Q
from granary.functions import text as T
from granary.operators import analytics, incremental, memory, mining, retrieval, sections
from granary.sources import files, views
from granary.streaming import metrics


def test_html_documents(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xc3\xa9 \xff</p>")
    (tmp_path / "b.HTM").write_text("<h1>x</h1>")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.file: r for r in files.html_documents(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.html", "b.HTM"]
    assert "café" in rows["a.html"].html and len(rows["a.html"].sha256) == 64


def test_chunk_lines_and_manifest(spark, tmp_path):
    lines = [{"id_": "1", "text": "a", "metadata": {"file": "f"}}, {"id": "2", "text": "b", "meta": {"file": "g"}}]
    (tmp_path / "chunks.jsonl").write_text("\n".join([*map(json.dumps, lines), "{bad"]))
    got = {r.id_: r.metadata["file"] for r in files.chunk_lines(spark, str(tmp_path / "chunks.jsonl")).collect()}
    assert got == {"1": "f", "2": "g"}
    path = str(tmp_path / "manifest")
    assert files.manifest(spark, path).count() == 0
    files.save_manifest(spark.createDataFrame([("f", "s", 1.0, 2, 3)], files.MANIFEST), path)
    assert files.manifest(spark, path).first().sections == 2
    files.append(spark.range(2), str(tmp_path / "log"))
    files.append(spark.range(1), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    files.export_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["id"]


def test_upsert_replaces_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k int, v string, p int")
    incremental.upsert(path, df([(1, "a", 0), (2, "b", 1)]), "k", "p")
    incremental.upsert(path, df([(3, "c", 1)]), "k", "p")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["a", "c"]


def test_unchanged_input_changes_nothing(spark, small):
    now = views.table(spark, small, "pages").select(F.col("url").alias("file"), F.sha2("html", 256).alias("sha256"))
    assert incremental.changed(now, now).count() == 0 and incremental.removed(now, now).count() == 0


def test_stream_equals_batch(spark, small, tmp_path):
    logs = views.query_logs(spark, small).select("id", "timestamp", "total_time_ms", "conversation_id")
    logs.write.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs"))
    got = metrics.run_available(metrics.daily_counts(stream), "daily", str(tmp_path / "ck"))
    want = logs.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("total_time_ms").alias("ms"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    once = metrics.run_available(metrics.once(stream, "id", "timestamp"), "once", str(tmp_path / "ck2"), "append")
    assert once.count() == logs.count()


def test_worked_examples(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.normal_title(F.lit("4.3.5Route Validation"))) == "route validation"
    assert one(T.normal_title(F.lit("1.KEY RESPONSIBILITIES"))) == "key responsibilities"
    assert one(T.heading_number(F.lit("7.2"))).title == "7.2"
    assert one(T.pack_greedy(F.array(*map(F.lit, (3, 4, 5, 6, 2, 9))), 10)) == [0, 0, 1, 2, 2, 3]
    words = " ".join(f"w{k}" for k in range(300))
    parts = one(T.split_long(F.lit(words), 40, 0))
    assert " ".join(parts) == words
    assert all(one(T.split_long(F.lit(words), 4, 400))), "overlap as long as the window still moves on"
    assert one(T.extract_section(F.lit("Process\na\nRecords\nkeep\nCompliance\nb"), "records")) == "Records\nkeep"
    assert one(Q.intent(F.lit("How to do a fire drill"))).type == "procedural"
    assert one(Q.intent(F.lit("What records to keep"))).type == "recordkeeping"
    assert one(Q.intent(F.lit("Summarize the manual"))).type == "summarization"
    assert one(T.highlight(F.lit("x\nRecords: y"))) == "x\n\n🔹 SECTION: RECORDS 🔹\n y"
    assert mining.phrase_pattern("a b") == r"a[\s\-/]+b"
    assert one(T.heading_like(F.lit("Key Points"))) and one(T.heading_like(F.lit("ends:"))) and not one(T.heading_like(F.lit("just some plain words here")))


def test_html_blocks():
    page = "<h1>1 A</h1><p>x &amp; y<p>z<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table><script>var t='</p>'</script><ul><li>l</li></ul>"
    assert sections.parse(page) == [("h1", "1 A"), ("p", "x & y"), ("p", "z"), ("tr", "h | i"), ("tr", "1 | 2"), ("li", "l")]
    assert sections.parse(None) == []


def test_vector_topk_prefix_and_blocks(spark, small):
    e = views.table(spark, small, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    five = {(r.query_id, r.rank): r.vec_id for r in retrieval.vector_topk(q, e, 5).collect()}
    before = retrieval.BLOCK
    try:
        retrieval.BLOCK = 2
        three = {(r.query_id, r.rank): r.vec_id for r in retrieval.vector_topk(q, e, 3).collect()}
    finally:
        retrieval.BLOCK = before
    assert three == {k: v for k, v in five.items() if k[1] <= 3}
    assert retrieval.vector_topk(q.where("false"), e, 3).count() == 0


def test_bounds_and_memory(spark):
    with pytest.raises(ValueError, match="days"):
        analytics.bounded(0, 1, 365, "days")
    rows = spark.createDataFrame([(1, "c:1", "user", " hi "), (2, "c:1", "robot", "x"), (3, "c:1", "user", "  "), (4, "c:1", None, "y")], "id long, conversation_id string, role string, content string")
    assert [(r.id, r.content) for r in memory.valid(rows).collect()] == [(1, "hi")]
    assert [r.is_valid for r in memory.is_valid(rows).orderBy("id").collect()] == [True, False, False, False]
    assert memory.delete_conversation(rows, "c:1", "d").count() == 4 and memory.delete_conversation(rows, "c:1", "c").count() == 0
