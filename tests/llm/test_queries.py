"""The registered corpus queries: rows equal to their SQL, and the pipeline's stages in order."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import database, difference
from wardline.llm import queries

PLANS = {n: name for name in queries.QUERIES for n in [int(re.match(r"op(\d+)_", name)[1])]}


def test_one_query_for_each_operator():
    assert sorted(PLANS) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, data, name):
    assert difference(database(data), entry.queries()[name](spark, data), queries.ORACLE[name]) is None


REPORTS = ["op5_substring_dedup", "op10_benchmark_decontamination"]  # rows of the documents concerned only


@pytest.mark.parametrize("name", REPORTS)
def test_report_names_each_document_once(spark, data, name):
    found = [r["doc_id"] for r in entry.queries()[name](spark, data).collect()]
    there = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    assert 0 < len(found) < len(there) and len(found) == len(set(found)) and set(found) <= there


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - set(REPORTS)))
def test_query_has_a_row_for_every_row(spark, data, name):
    table = "embeddings" if name.startswith("op9") else "documents"
    found = entry.queries()[name](spark, data)
    key = "vec_id" if name.startswith("op9") else "doc_id"
    assert sorted(r[0] for r in found.select(key).collect()) == sorted(
        r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect())


def test_pipeline_stages(spark, data):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.columns == (columns if name != "source_mixing" else [*columns, "copies"])
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    assert entry.queries()["pipeline"](spark, data).count() == counts[-1]
