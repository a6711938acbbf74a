"""The physical plans keep the properties the design relies on."""

import re

import pytest
from builders import aggregate_rows

from rillwatch.operators import (
    decode_frames,
    drop_late,
    expanding_stats,
    microflow_aggregate,
    packet_traffic,
    parse_flows,
    rolling_anomalies,
    traffic_aggregate,
)
from rillwatch.plans import derived
from rillwatch.schemas import FRAMES

NETWORK = (derived.LOCAL_NET, derived.LOCAL_MASK)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    spark.catalog.clearCache()
    return derived.events_table(spark, sf_dir)


def test_microflows_take_one_shuffle_with_partial_hash_aggregation(events):
    text = plan(microflow_aggregate(derived.packets(events), *NETWORK))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_max_by" in text and "SortAggregate" not in text and "Window" not in text


def test_traffic_takes_two_shuffles_and_splits_a_window_by_flow(events):
    text = plan(packet_traffic(derived.packets(events), *NETWORK))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 2
    assert "src_ip" in exchanges[1] and "collect_set" not in text and "SortAggregate" not in text


def test_only_needed_columns_are_read(events):
    text = plan(packet_traffic(derived.packets(events), *NETWORK))
    assert "props" not in re.search(r"ReadSchema: \S+", text).group(0)
    assert "PushedFilters: [IsNotNull(ts)]" in text


def test_short_captures_are_skipped_in_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "frames")
    derived.frames(events).write.parquet(path)
    text = plan(decode_frames(spark.read.schema(FRAMES).parquet(path)))
    assert "GreaterThanOrEqual(caplen,34)" in text and "Python" not in text


def test_a_record_is_parsed_once(spark, events, tmp_path):
    path = str(tmp_path / "raw")
    derived.raw_records(events).write.parquet(path)
    text = plan(traffic_aggregate(parse_flows(spark.read.parquet(path))))
    assert len(re.findall(r"Generate inline\(array\(struct\(_typed, from_json", text)) == 1
    # the usual types (a BIGINT count) appear in that one expression only
    assert text.count("from_json(StructField(src_ip,StringType,true), StructField(dst_ip,StringType,true),"
                      " StructField(protocol,StringType,true), StructField(dir,StringType,true),"
                      " StructField(src_port,LongType,true)") == 1


def test_no_step_gathers_a_keys_rows_in_one_task(spark, events):
    rows = aggregate_rows(spark, [(n, 1, 1, 1) for n in range(10)])
    for df in (rolling_anomalies(rows), expanding_stats(rows)):
        text = plan(df)
        assert "SinglePartition" not in text
        # windows over a whole key see chunk summaries only
        for line in text.splitlines():
            if "Window [" in line and not re.search(r"_chunk|_block", line.split("windowspecdefinition")[1]):
                raise AssertionError(line)
    late = plan(drop_late(derived.arrivals(events), "1 hour", ("arrival", "pkt_seq")))
    assert "CartesianProduct" not in late and "BroadcastNestedLoopJoin" not in late
