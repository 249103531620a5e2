"""Readers that turn stored tables into texts, batches, chat turns and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.arrays import computed_once, exploded
from wardline.functions.markup import markup_text
from wardline.schemas import BATCHES, CONVERSATIONS, DOCUMENTS, EVENTS, REQUESTS
from wardline.session import spread


def requests(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Validation requests with the fixed schema; nothing is inferred."""
    return spark.read.schema(REQUESTS).format(file_format).load(path)


def batches(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.schema(BATCHES).format(file_format).load(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents.parquet")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CONVERSATIONS).parquet(f"{folder}/conversations.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as texts to check: their readable text, extracted once and on all cores."""
    read = spread(pages(spark, folder), "page_id")
    return computed_once(read.select("page_id", "url", "html"), {"text": markup_text(F.col("html"))}).drop("html")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Request log; the stored wall-clock times are taken as UTC instants."""
    return (spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
            .withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def batch_texts(batch_rows: DataFrame, batch_id: str = "batch_id", texts: str = "texts") -> DataFrame:
    """One row per text of a batch, with its position from 0."""
    others = [c for c in batch_rows.columns if c not in (batch_id, texts)]
    return exploded(batch_rows, [batch_id, *others], F.col(texts), "text", "pos")


def texts_with_contexts(batch_rows: DataFrame, batch_id: str = "batch_id", texts: str = "texts",
                        contexts: str = "contexts") -> DataFrame:
    """One row per text with the context at its position, NULL where there are fewer contexts.

    Positions beyond the texts are contexts without a text, and are left out.
    """
    padded = F.coalesce(contexts, F.array().cast("array<string>"))
    zipped = F.arrays_zip(F.col(texts).alias("t"), F.slice(padded, 1, F.size(texts)).alias("c"))
    return (exploded(batch_rows, [batch_id], zipped, "_pair", "pos")
            .select(batch_id, "pos", F.col("_pair.t").alias("text"), F.col("_pair.c").alias("context")))
