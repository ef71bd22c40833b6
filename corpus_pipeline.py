"""Corpus pipeline over documents: quality, near duplicates, repeats, benchmark, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again before the next; all but the last return the columns
of documents.  Near-duplicate detection needs all sets at once, so no stage is
expressible in SQL at scale: ``ORACLE_SQL`` is None and tests compare the stages
with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import scratch
from pointloom.llm import decontam, jaccard, packing, quality, suffixes


def _begin(spark: SparkSession, stage: str):
    """Tables that earlier stages have cut are done with once this stage begins: their output is written."""
    names = [name for name, _ in STAGES]
    for done in names:
        scratch.release(spark, f"pipeline {done}")
    return scratch.owned(f"pipeline {stage}")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    with _begin(spark, "quality"):
        return quality.kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of similar ones.

    Rows of one id are one document and stay together; rows without id stay.
    """
    with _begin(spark, "near_duplicates"):
        groups = jaccard.similar_groups(docs)
        losers = groups.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(losers, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that occur earlier; ``n_chars`` follows the text."""
    with _begin(spark, "repeats"):
        left = suffixes.without_repeats(docs)
        if "n_chars" in docs.columns:
            left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return left.select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    with _begin(spark, "benchmark"):
        return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    with _begin(spark, "packing"):
        return packing.pack(packing.tokenize(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with scratch.owned("pipeline output"):
            docs = scratch.cut(out)
    return docs
