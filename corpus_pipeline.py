"""Documents to token counts: rules, line dedup, near copies, benchmark leaks, then encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bpe, decontam, line_dedup, ngram_join, quality
from folio.llm.common import cut, drop
from folio.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines are removed from the others."""
    return quality.apply_rules(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stood earlier are deleted from texts."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words and 0.8, as all stages on word shingles."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests."""
    return bpe.encode_documents(docs, tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near copies", near_copies),
    ("decontamination", benchmark_leaks),
    ("encoding", encoding),
]
#: SQL has no BPE; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = cut(kept)
        drop(kept)  # the tables that it was made of, the stage's input among them
    return STAGES[-1][1](spark, docs, sf_dir)
