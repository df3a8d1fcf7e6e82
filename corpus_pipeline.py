"""A training-corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Null and empty texts break a quality rule and go in the first stage; given to a
later one they pass (they have no words, no links, no windows and no item).
Rows with a null identifier pass near_dedup, as they can't be named; repeated
rows are judged alike, and near_dedup keeps all rows of the identifier that
stays. An empty table gives an empty table. All columns of the table pass
through, whatever their names; the last stage returns its own. A very long text
is worked on whole by the task that has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushtable.llm import byte_bpe, decontaminate, minhash, quality, substrings
from hushtable.llm.common import kept_table, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest identifier."""
    return minhash.first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier go from the texts; documents without a word left go."""
    return substrings.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token ids: digests of the ids and of what they decode to."""
    return byte_bpe.tokenized(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: BPE can't be put in SQL, and the stages before it would be too slow there on whole tables; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
