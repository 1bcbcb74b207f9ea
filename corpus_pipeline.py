"""The corpus pipeline: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, langid, linededup, neardup, spm
from marlstone.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the model knows; null and empty texts go, repeated rows stay or go together."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines like an earlier line of the corpus; a document of which nothing is left goes, one that had no words stays."""
    return linededup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near copies; rows without doc_id or words stay."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and byte spans of every row that is left, through Unicode's compatibility map; null and empty texts have none."""
    return spm.encode(docs, charsmap=spm.nfkc_map())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Trained models and tokenizers can't be expressed in SQL; a test compares the result with the same rules in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``, each stage's output written to the shared folder and read by the next.

    Every stage reads whole texts of any length, passes on all columns whatever their names (the last
    gives its own), and makes an empty table of an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # what the stage before wrote isn't needed any more
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", instead_of=docs)
    return docs
