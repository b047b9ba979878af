"""A training-data pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its
predecessor kept, and all but the last return the columns of documents. ``run`` writes each
stage's result as Parquet in the shared folder and reads it as the next one's input; ``colloquy.llm.common.clear`` deletes
what it wrote once the rows have been used.

Each stage's handling of nulls, empty texts, repeated rows and empty tables is stated in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import line_dedup, minhash, packing, quality, substring
from colloquy.llm.common import written
from colloquy.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that repeat go, but for the first."""
    return line_dedup.remove_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words that stand in several places go."""
    return substring.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality", quality_rules), ("lines", line_chunks), ("near", near_dedup), ("substrings", substring_dedup), ("packing", packed)]

#: Line chunks and tokenizers can't be expressed in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}-{name}")
    return docs
