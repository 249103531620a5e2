"""Trace spans: durations, tags, logs, and the join to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.joins import lookup_join


def with_duration(spans: DataFrame, start: str = "start_micros", end: str = "end_micros") -> DataFrame:
    return spans.withColumn("duration_ms", (F.col(end) - F.col(start)) / 1000.0)


def set_tag(tags: Column, key: str, value: Column) -> Column:
    """The tags with one set; an earlier value of the same key is replaced."""
    empty = F.create_map().cast("map<string,string>")
    others = F.map_filter(F.coalesce(tags, empty), lambda k, _: k != key)
    return F.map_concat(others, F.create_map(F.lit(key), value.cast("string")))


def add_log(logs: Column, timestamp: Column, message: Column, level: str = "info") -> Column:
    """The logs with one entry appended; entries stay in the order they were added."""
    entry = F.struct(timestamp.cast("double").alias("timestamp"), F.lit(level).alias("level"),
                     message.cast("string").alias("message"))
    empty = F.array().cast("array<struct<timestamp:double,level:string,message:string>>")
    return F.concat(F.coalesce(logs, empty), F.array(entry))


def flat_tags(tags: Column) -> Column:
    """``key=value`` pairs in key order, joined by ``;``."""
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def with_requests(spans: DataFrame, requests: DataFrame, row_id: str = "span_id",
                  request_id: str = "request_id") -> DataFrame:
    """Spans with the request they belong to; one request may own any number of spans."""
    return lookup_join(spans, requests, [request_id], row_id, "left")
