"""Functions for SQL text: register(spark) makes them known to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.sections import section_tree
from .text import _decode


class _Sections:
    """Table function: the sections of a page."""

    def eval(self, html: str):
        for k, s in enumerate(section_tree(html)):
            yield k, s["number"], s["title"], s["depth"], s["anchor"], len(s["blocks"])


def _geometric_mean(values: pd.Series) -> float:
    import numpy as np

    return float(np.exp(np.log(values[values > 0]).mean())) if (values > 0).any() else 0.0


def register(spark: SparkSession) -> None:
    """granary_unescape(text), the aggregate granary_geometric_mean(double), and the table function granary_sections(html)."""
    spark.udf.register("granary_unescape", F.pandas_udf(_decode, "string"))
    spark.udf.register("granary_geometric_mean", F.pandas_udf(_geometric_mean, "double"))
    spark.udtf.register("granary_sections", F.udtf(_Sections, returnType="section int, number string, title string, depth int, anchor string, n_blocks int"))
