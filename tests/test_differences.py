"""What differed from SQL on larger tables."""

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import analytics
from granary.plans.catalog import QUERIES


def test_title_that_begins_with_a_number_keeps_it(spark, tmp_path):
    spark.createDataFrame([(7, "u", "<h1>404893 m</h1>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["heading_parts"](spark, str(tmp_path)).first().asDict() == {"page_id": 7, "number": "7.2", "title": "404893 m", "normal": "404893 m"}


def test_percentiles_are_exact(spark):
    logs = spark.range(200_000).select(F.lit("c").alias("client_id"), F.col("id").alias("total_time_ms")).unionByName(spark.createDataFrame([("c", None), ("d", None)], "client_id string, total_time_ms long"))
    assert sorted(map(tuple, analytics.latency_percentiles(logs).select("client_id", "p50", "p95", "n").collect())) == [("c", 99_999, 189_999, 200_001), ("d", None, None, 1)]


def shown(spark, f):
    rows = spark.createDataFrame([("<h1>a&amp;&amp</h1>&am &eacute;&notit;&#38;&#233",), ("b&quot;",), (None,)], "html string")
    return [r[0] for r in rows.select(f(F.col("html"), True)).collect()]


def test_whole_text_leaves_references_without_semicolon(spark):
    assert shown(spark, T.whole_text) == ["a&&amp &am é&notit;&&#233", 'b"', None]


def test_strip_tags_leaves_references_without_semicolon(spark):
    assert shown(spark, T.strip_tags) == ["a&&amp &am é&notit;&&#233", 'b"', None]
    assert spark.range(1).select(T.strip_tags(F.lit("a&amp b"))).first()[0] == "a& b"
