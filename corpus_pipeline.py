"""The corpus pipeline: documents go through the stages in order, each one's result written before the next.

Every stage gets and returns the columns of ``documents``; the last adds the number of copies drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import leaks, lines, quality, queries, simhash
from wardline.llm.common import Scratch


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The documents as one column ``_row``, beside the columns that a stage reads: their names meet no others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def _fields(columns: list[str], **instead: Column) -> list[Column]:
    return [instead.get(c, F.col("_row")[c]).alias(c) for c in columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality."""
    return quality.classified(_whole(docs, "doc_id", "text")).where("_keep").select(*_fields(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; ``n_chars`` follows the text."""
    kept = lines.deduplicated(_whole(docs, "doc_id", "text"))
    return kept.select(*_fields(docs.columns, text=F.col("_kept"), n_chars=F.length("_kept").cast("long")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of fingerprints within two bits, of 3-word shingles."""
    return simhash.without_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks.leaks(_whole(docs, "text"), benchmark, carry=["_row"])
    return found.where(F.size("_spans") == 0).select(*_fields(docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the production mix, each once with the number of its copies in ``copies``."""
    drawn = queries.mixed_documents(_whole(docs, "doc_id", "text", "source", "lang")).where("_copies > 0")
    return drawn.select(*_fields([c for c in docs.columns if c != "copies"]), F.col("_copies").alias("copies"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

ORACLE_SQL = None  # the classifier is trained; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result lies in the shared folder before the next one reads it."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
