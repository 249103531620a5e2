"""Every registered query against its SQL, and the contract of the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import database, difference
from wardline.plans import catalog

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
OWN = {name for name in QUERIES if name in catalog.QUERIES}
ROWS_ONLY = {"stream_dedup", "ml_toxicity"}


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(OWN & set(ORACLE)))
def test_query_equals_sql(spark, data, con, name):
    assert difference(con, QUERIES[name](spark, data), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_every_other_query_has_sql():
    assert OWN - set(ORACLE) == ROWS_ONLY


def test_entry_has_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() == 200
