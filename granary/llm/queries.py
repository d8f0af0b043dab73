"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .chat import op3_chat
from .common import table
from .decontaminate import op8_decontaminate
from .html_text import op9_html
from .language import op1_language
from .lm import op10_lm
from .packing import op2_packing
from .quality import op5_quality
from .simhash import op7_simhash
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op4_toxicity

_DOCS = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op10_lm": op10_lm,
    "op7_simhash": op7_simhash,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on_docs = {name: (lambda s, d, f=f: f(table(s, d, "documents"))) for name, f in _DOCS.items()}
    return on_docs | {
        "op4_toxicity": lambda s, d: op4_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op3_chat": lambda s, d: op3_chat(table(s, d, "conversations")),
        "op9_html": lambda s, d: op9_html(table(s, d, "pages")),
        "op8_decontaminate": lambda s, d: op8_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": oracles.OP3, "op8_decontaminate": oracles.OP8}
