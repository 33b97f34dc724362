"""A corpus pipeline: quality filter, exact and near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of ``documents``; the last returns the mix (doc_id,
size, source_size, target, taken).  Null texts count as empty; rows that share an
id, or have none, and differ in text are documents of their own.  The operators'
docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm._store import cut, made, release
from lattica.llm.decontam import drop_contaminated
from lattica.llm.exact_dedup import drop_copies
from lattica.llm.mixing import mix_sources
from lattica.llm.near_dedup import drop_near_copies
from lattica.llm.quality import quality_filter, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labels of these documents, rejects."""
    return quality_filter(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id; repeats of a row go."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL can express neither the classifier nor the tiling; a test compares all rows and columns with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``; between stages the documents are kept in the shared folder, and what a stage needed is removed."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs = cut(docs)
            release(spark, begun, docs)
        docs = stage(spark, docs, sf_dir)
    return docs
