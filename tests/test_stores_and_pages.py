"""Loaders, sinks, streams, registered functions, and pages that the tables don't have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions import text as T
from granary.functions import udfs
from granary.operators import analytics, anchors, mining, retrieval, sections
from granary.sources import files
from granary.streaming import metrics


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_broken_manifest_is_an_empty_one(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"file": "a", "sha256": "x"}\n{"file": "b", "sha\n')
    assert files.manifest(spark, str(tmp_path / "m.json")).count() == 0
    (tmp_path / "n.json").write_text('{"file": "a", "sha256": "x"}\n\n')
    assert files.manifest(spark, str(tmp_path / "n.json")).first().file == "a"


def test_rules_round_trip(spark, tmp_path):
    built = spark.createDataFrame([("1.1", 1, ["a: b", 'q"x']), ("2.1", None, ["é"])], "viq_no string, chapter_no int, patterns array<string>")
    names = spark.createDataFrame([("ecdis", ["e.c.d.i.s", "e c d i s"])], "base string, variants array<string>")
    files.save_rules(spark, built, str(tmp_path / "rules"), ("the", "a"), ("ship",), names)
    got = files.rules(spark, str(tmp_path / "rules"))
    assert got["viq_rules"] == [{"viq_no": "1.1", "chapter_no": 1, "patterns": ["a: b", 'q"x']}, {"viq_no": "2.1", "chapter_no": None, "patterns": ["é"]}]
    assert got["global_stopwords"] == ["a", "the"] and got["synonyms"] == {"ecdis": ["e.c.d.i.s", "e c d i s"]}
    (tmp_path / "bad.yaml").write_text("a: [1\n  b")
    assert files.rules(spark, str(tmp_path / "bad.yaml")) == {} == files.rules(spark, str(tmp_path / "none.yaml"))


def test_synonym_schemas(spark):
    df = spark.createDataFrame
    pairs = lambda tables: sorted(map(tuple, files.synonym_pairs(tables).collect()), key=repr)
    assert pairs({"maritime_terms": df([(1, " AIS ")], "id int, Exact_Term string"), "term_synonyms": df([(1, "X"), (2, "y")], "term_id int, synonym string")}) == [("ais", "x")]
    assert pairs({"maritime_terms": df([("A", "B"), ("A", None)], "term string, synonym string")}) == [("a", "b")]
    assert pairs({"terms": df([("A",)], "term string"), "synonyms": df([("A", "c")], "term string, synonym string")}) == [("a", "c"), ("a", None)]
    assert pairs({"terms": df([("A",)], "term string"), "synonyms": df([("c",)], "synonym string")}) == [("a", None), ("c", None)]
    assert pairs({"maritime_terms": df([("GPS",)], "exact_term string")}) == [("gps", None)]
    assert files.synonym_pairs({"other": df([("x",)], "a string")}) is None
    got = mining.synonym_map(df([("gps", None), ("ab", "updated"), ("ab", "12")], "base string, synonym string")).collect()
    assert [(r.base, r.variants) for r in got] == [("gps", ["g p s", "g.p.s"])]
    assert files.questions(df([(1, "q")], "CHAPTER_NO int, viq_QUESTION string")).first().asDict() == {"chapter_no": 1, "viq_no": None, "viq_question": "q", "procedural_requirements": None}


def test_numbered_and_logged_rows(spark, tmp_path):
    path = str(tmp_path / "fb")
    rows = spark.createDataFrame([("a",), ("b",)], "question string")
    first = {r.id for r in files.append_numbered(rows, path).collect()}
    second = {r.id for r in files.append_numbered(rows, path).collect()}
    assert len(first | second) == 4 and min(second) > max(first) and min(first) >= 1
    logs = spark.createDataFrame([(1, [("t", None, "/u", 0.5, ["v"], [], "x" * 900)]), (2, [])], f"id long, references {files.REFERENCES}")
    files.append_logs(logs, str(tmp_path / "l"), str(tmp_path / "r"))
    ref = spark.read.parquet(str(tmp_path / "r")).first()
    assert (ref.query_log_id, ref.reference_rank, ref.viq_codes, ref.tags, len(ref.text_snippet)) == (1, 1, '["v"]', None, 500)
    assert {r.id: r.top_reference_title for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {1: "t", 2: None}
    files.reset("id long", spark, path)
    assert spark.read.parquet(path).count() == 0
    new = files.migrated(spark.createDataFrame([(1, 5)], "id int, old int"), StructType.fromDDL("id bigint, note string"))
    assert new.dtypes == [("id", "bigint"), ("note", "string"), ("old", "int")] and new.first().note is None
    with pytest.raises(ValueError, match="json or csv"):
        files.exported(new, "xml")
    files.save_settings(spark, {"chunk_size": 5}, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().chunk_size == 5


def test_bounds():
    assert analytics.checked(days=365, page_size=1) == {"days": 365, "page_size": 1}
    for bad in ({"days": 0}, {"timeline_days": 91}, {"limit": 1001}, {"qa_limit": 0}, {"page_size": 101}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            analytics.checked(**bad)


def at(*minutes):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in minutes]


def test_streams(spark, tmp_path):
    rows = [(k, t, "c", k) for k, t in enumerate(at(0, 10, 50, 200))]
    schema = "id long, timestamp timestamp, conversation_id string, total_time_ms long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = metrics.run_available(metrics.sessions(stream()), "sess", str(tmp_path / "c1"), "complete").collect()
    assert sorted(r.n for r in got) == [1, 1, 2]
    got = metrics.run_available(metrics.sliding_counts(stream(), "1 hour", "30 minutes"), "slide", str(tmp_path / "c2")).collect()
    assert sum(r.n for r in got) == 2 * len(rows)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "timestamp timestamp, total_time_ms long"
    path, ck = str(tmp_path / "late"), str(tmp_path / "ck")
    for minutes in ((0,), (60 * 24 * 5,), (5,)):  # the last comes five days late
        spark.createDataFrame([(t, 1) for t in at(*minutes)], schema).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        query = metrics.daily_counts(stream, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    spark.createDataFrame([(t, 1) for t in at(60 * 24 * 9)], schema).write.mode("append").parquet(path)
    query = metrics.daily_counts(spark.readStream.schema(schema).parquet(path), "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.day, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("2024-01-01", 1), ("2024-01-06", 1)}


def test_stream_keeps_a_table(spark, tmp_path):
    schema, path = "id long, v long, t string", str(tmp_path / "in")
    for rows in ([(1, 1, "a"), (2, 1, "b"), (1, 0, "z")], [(1, 2, "c"), (3, 1, "d"), (2, 0, "old")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        metrics.keep_upserted(spark.readStream.schema(schema).parquet(path), str(tmp_path / "t"), "id", "v", str(tmp_path / "ck"))
    last = [spark.read.parquet(f"{tmp_path}/t/{k}") for k in (0, 1)]
    assert sorted(map(tuple, last[1].collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


PAGE = """<body><p>lead</p><a name="a0"></a><h1>1 Top</h1>loose<p>first &amp; second</p><p>- bullet one</p><p><b>Records</b> to keep</p>
<div><h2 class="x">2.1Route</h2></div><table><thead><tr><th>k</th><th>v</th></tr></thead><tr><td>1</td><td>2</td></tr><tr><td>k</td><td>v</td></tr></table><ul><li>x<li>y</ul>
<p class="Heading3" id="own">Last</p></body>"""


def test_section_tree():
    found = sections.section_tree(PAGE)
    assert [(s["number"], s["title"], s["depth"], s["anchor"], s["path"]) for s in found] == [("1", "Top", 1, "a0", "1"), ("2.1", "Route", 2, "a0", "2.1"), (None, "Last", 3, "own", "3.3")]
    assert [(b["kind"], b["text"]) for b in found[0]["blocks"]] == [("paragraph", "1 Top\n\nloose first & second"), ("list", "- - bullet one"), ("callout", "Records to keep"), ("paragraph", "2.1Route"), ("table", "1 | 2"), ("list", "- x\n- y"), ("paragraph", "Last")], "to the end: the next heading isn't beside this one"
    assert found[1]["blocks"] == [] and found[2]["blocks"] == []
    assert sections.table_rows(next(x for x in sections.tree(PAGE).walk() if x.tag == "table")) == (["k", "v"], [["1", "2"]])
    alone = sections.section_tree("just text<p>more")
    assert [(s["title"], [b["text"] for b in s["blocks"]]) for s in alone] == [("Document", ["just text more"])]
    assert sections.section_tree(None)[0]["blocks"] == [] and sections.tag_nodes("<ul><li>a<li>b</ul><p>c") == [("ul", "a b"), ("li", "a\nb"), ("p", "c")]


def test_long_blocks_are_cut(spark):
    words = " ".join(f"w{k}" for k in range(200))
    pages = spark.createDataFrame([("f", f"<h1>1 A</h1><p>{words}</p><p>tail</p>"), ("g", None), ("h", "<h1>x</h1>")], "file string, html string")
    got = sections.chunked(sections.section_blocks(pages), 40).orderBy("chunk", "part").collect()
    assert " ".join(" ".join(r.text.split()) for r in got) == f"1 A {words} tail"
    assert len(got) > 1 and all(r.tokens <= 40 for r in got)


def test_anchor_edges(spark):
    pages = spark.createDataFrame([("f", '<h2>Two</h2><a name="_Toc1"></a><a name="n1"></a><h2>Three <a id="in">x</a></h2>'), ("g", None)], "file string, html string")
    got = {(r.title, r.anchor) for r in anchors.heading_anchors(pages).collect()}
    assert got == {("Two", None), ("Three x", "n1")}
    assert [r.text for r in anchors.bookmark_sections(pages, 5).collect()] == ["Three x"]
    assert [r.anchor for r in anchors.resolve(spark.createDataFrame([("f", None)], "file string, title string"), anchors.anchor_index(pages)).collect()] == ["sec-untitled"]


def test_small_functions(spark):
    assert one(spark, T.strip_tags(F.lit("<p>a&eacute;&#8364;&amp;lt; <b>x</b></p>"))) == "aé€&lt; x"
    assert one(spark, T.split_sentences(F.lit("One two. Three four! Five six."), 5, 2)) == ["One two. Three four!", "Three four! Five six."]
    assert one(spark, T.record_books(F.lit("see np-133c"))) == ["NP 133C", "NP133C", "NP-133C"]
    assert one(spark, T.doc_url(F.lit("c"), F.lit(""))) == "" and one(spark, T.doc_url(F.lit("c"), F.lit("/a b.html#x#y"))) == "/c/docs/a%20b.html#x#y"
    assert mining.acronym_pattern(" ") is None
    t = retrieval.Timings()
    with t.stage("retrieval"):
        pass
    assert set(t.total()) == {"retrieval", "total"}
    udfs.register(spark)
    assert spark.sql("select granary_unescape('&lt;')").first()[0] == "<"
    assert spark.sql("select round(granary_geometric_mean(x), 6) from values (1D), (4D) t(x)").first()[0] == 2.0
    assert [r.title for r in spark.sql("select * from granary_sections('<h1>A</h1><h2>B</h2>')").collect()] == ["A", "B"]
