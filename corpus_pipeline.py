"""Documents to training sequences: the stages of the corpus pipeline, in order.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs.

In every stage null texts count as empty, repeated rows are each judged on their own (near-duplicates keep one of them), rows
with a null id are never learnt from and stay unless their text goes, other columns pass through whatever their
names, and an empty table stays one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import shared_dir, table
from granary.llm.decontaminate import decontaminate
from granary.llm.packing import pack
from granary.llm.similar import deduplicate
from granary.llm.suffix_dedup import remove_repeats
from granary.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one with the smallest id stays."""
    return deduplicate(docs, width=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 400 that also start elsewhere go, and so do passages of more than 50 words; the
    documents stay."""
    return remove_repeats(docs, least_words=51)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash", near_duplicates),
    ("suffix_array", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packing),
]

#: Fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/granary/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
