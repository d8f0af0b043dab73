"""What several operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, texts), a row an id. Ids alone are counted first; texts are shuffled only if one comes twice."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.select("doc_id", F.array("text").alias("texts"))
    return docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
