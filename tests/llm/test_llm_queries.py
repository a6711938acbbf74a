"""Queries of this subpackage that SQL can express, against DuckDB."""

import os

import pytest
from compare import compare, tables

from rillwatch.llm.queries import ORACLE, QUERIES

QUERY_DIR = os.environ.get("TEST_QUERY_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, tables(QUERY_DIR), QUERIES[name], ORACLE[name], QUERY_DIR) is None


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
