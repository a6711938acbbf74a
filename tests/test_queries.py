"""Every registered query against its SQL, on tables large enough to give each one rows."""

import glob
import os

import pytest
from compare import compare, tables
from pyspark.sql import functions as F

import __spark_entry__ as contract

QUERY_DIR = os.environ.get("TEST_QUERY_DIR", "/root/testdata/sf0.01")
# the queries of the optional subpackage have tests of their own
QUERIES = {k: v for k, v in contract.queries().items() if k not in contract.LLM_QUERIES}
ORACLE = {k: v for k, v in contract.oracle_sql().items() if k not in contract.LLM_QUERIES}


@pytest.fixture(scope="module")
def db():
    return tables(QUERY_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert compare(spark, db, QUERIES[name], ORACLE[name], QUERY_DIR) is None


def test_entry_has_stable_schema(spark):
    assert contract.entry(spark).columns[:3] == ["key", "window_start", "metric"]


@pytest.fixture(scope="module")
def brief_dir(spark, tmp_path_factory):
    """Events of a little over three hours: closed windows, but too few for a warning."""
    folder = str(tmp_path_factory.mktemp("brief"))
    seq = F.col("id")
    spark.range(200).select(
        seq.alias("event_id"),
        F.timestamp_seconds(1704067200 + seq * 60).cast("timestamp_ntz").alias("ts"),
        (seq % 60).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("click", "view", "purchase", "error", "signup"))), (seq % 5 + 1).cast("int")).alias("event_type"),
        (seq % 60 + 10.0).alias("value"),
        F.lit("").alias("props"),
    ).coalesce(1).write.parquet(f"{folder}/table")
    # one file, as the given tables have it
    os.rename(glob.glob(f"{folder}/table/part-*.parquet")[0], f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["alert_delivery", "stream_latest_warnings", "applications"])
def test_query_without_warnings_gives_what_its_sql_gives(spark, brief_dir, name):
    db = tables(brief_dir)
    expected = db.execute(ORACLE[name]).fetchall()
    found = [tuple(row) for row in QUERIES[name](spark, brief_dir).collect()]
    assert sorted(found) == sorted(expected)


@pytest.fixture(scope="module")
def tie_dir(spark, tmp_path_factory):
    """One flow of 21 packets in a tick, whose mean gap is 27601632.95: a little less, as a DOUBLE."""
    folder = str(tmp_path_factory.mktemp("tie"))
    seq = F.col("id")
    spark.range(21).select(
        (seq * 5 + 1).alias("event_id"),
        F.timestamp_micros(1704067200000000 + (seq * 27601632.95).cast("bigint")).cast("timestamp_ntz").alias("ts"),
        F.lit(3).cast("bigint").alias("user_id"),
        F.lit("click").alias("event_type"),
        F.lit(10.0).alias("value"),
        F.lit("").alias("props"),
    ).coalesce(1).write.parquet(f"{folder}/table")
    os.rename(glob.glob(f"{folder}/table/part-*.parquet")[0], f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["flow_record_json", "flow_report", "microflow_json"])
def test_query_rounds_the_mean_as_its_sql(spark, tie_dir, name):
    assert compare(spark, tables(tie_dir), QUERIES[name], ORACLE[name], tie_dir) is None
