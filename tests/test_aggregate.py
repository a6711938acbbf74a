from builders import START, aggregate_rows, flow_rows
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rillwatch.operators import (
    closed_windows,
    drop_late,
    limit_alerts,
    traffic_aggregate,
)
from rillwatch.operators.ordered import running


def test_volume_by_direction_but_flags_and_flows_for_all(spark):
    flows = flow_rows(
        spark,
        [
            (0, "a", 1, "b", 2, "TCP", "INBOUND", 2, 100, 1),
            (1, "b", 2, "a", 1, "TCP", "OUTBOUND", 3, 50, 1),
            (2, "a", 1, "c", 2, "TCP", "LATERAL", 5, 999, 1),
            (3, "x", 1, "y", 2, "UDP", "UNKNOWN", 7, 999, 0),
            (9.9, "a", 1, "b", 2, "TCP", "INBOUND", 1, 20, 1),
            (10, "a", 1, "b", 2, "TCP", "INBOUND", 1, 1, 0),
        ],
    )
    first, second = traffic_aggregate(flows).orderBy("window_start").collect()
    assert (first.bytes_inbound, first.packets_inbound) == (120, 3)
    assert (first.bytes_outbound, first.packets_outbound) == (50, 3)
    assert (first.unique_flow_count, first.tcp_syn_total) == (4, 4)
    assert first.average_packet_size == 170 / 6 and first.key == "global-key"
    assert first.timestamp_end == START + timedelta(seconds=9.9)
    assert second.window_start == START + timedelta(seconds=10)


def test_missing_addresses_count_as_a_flow_and_exceed_one_limit(spark):
    flows = flow_rows(spark, [(0, None, 0, None, 0, "TCP", "INBOUND", 10, 1000, 10)])
    row = traffic_aggregate(flows).first()
    assert (row.bytes_inbound, row.packets_inbound, row.bytes_outbound) == (1000, 10, 0)
    assert (row.unique_flow_count, row.tcp_syn_total, row.average_packet_size) == (1, 10, 100.0)
    alerts = limit_alerts(traffic_aggregate(flows), 100, 100, 10).collect()
    assert [(a.metric, a.title, a.text) for a in alerts] == [
        ("bytes_inbound", "Alerta de bytes recebidos", "O último agregado registrou 1000 bytes recebidos")
    ]


def test_no_volume_gives_zero_average(spark):
    flows = flow_rows(spark, [(0, "a", 1, "b", 2, "TCP", "LATERAL", 5, 999)])
    assert traffic_aggregate(flows).first().average_packet_size == 0.0


def test_joined_identity_merges_some_flows(spark):
    flows = flow_rows(
        spark,
        [
            (0, "10.0.0.1", 11, "b", 2, "TCP", "INBOUND", 1, 1),
            (0, "10.0.0.11", 1, "b", 2, "TCP", "INBOUND", 1, 1),
        ],
    )
    assert traffic_aggregate(flows).first().unique_flow_count == 2
    assert traffic_aggregate(flows, key_mode="concat").first().unique_flow_count == 1
    with pytest.raises(ValueError):
        traffic_aggregate(flows, key_mode="other")


def test_groups(spark):
    flows = flow_rows(
        spark,
        [
            (0, "a", 1, "b", 2, "TCP", "INBOUND", 1, 10),
            (0, "a", 1, "b", 2, "UDP", "INBOUND", 1, 20),
            (0, None, 1, "b", 2, "TCP", "INBOUND", 1, 40),
        ],
    )
    by_host = {r.key: r.bytes_inbound for r in traffic_aggregate(flows, group_cols=["src_ip"]).collect()}
    assert by_host == {"a": 30, "global": 40}
    both = traffic_aggregate(flows, group_cols=["src_ip", "protocol"])
    assert {r.key for r in both.collect()} == {
        '{"src_ip":"a","protocol":"TCP"}',
        '{"src_ip":"a","protocol":"UDP"}',
        '{"src_ip":null,"protocol":"TCP"}',
    }


def test_splitting_a_flow_changes_no_sum(spark):
    whole = flow_rows(spark, [(0, "a", 1, "b", 2, "TCP", "INBOUND", 6, 60)])
    split = flow_rows(spark, [(0, "a", 1, "b", 2, "TCP", "INBOUND", 2, 20)] * 3)
    keep = ["bytes_inbound", "packets_inbound", "unique_flow_count"]
    assert traffic_aggregate(whole).select(keep).collect() == traffic_aggregate(split).select(keep).collect()


def test_a_flow_with_a_third_of_all_rows(spark):
    busy = spark.range(9000).select(
        (F.lit(START) + F.make_interval(secs=(F.col("id") % 10).cast("decimal(18,6)"))).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("src_ip"),
        F.lit(1).alias("src_port"),
        F.lit("b").alias("dst_ip"),
        F.lit(2).alias("dst_port"),
        F.lit("TCP").alias("protocol"),
        F.lit("INBOUND").alias("dir"),
        F.lit(1).cast("bigint").alias("packet_count"),
        F.lit(1).cast("bigint").alias("byte_count"),
        *[F.lit(0).cast("bigint").alias(f"tcp_{f}_count") for f in ("syn", "ack", "fin", "rst")],
    )
    row = traffic_aggregate(busy).first()
    assert (row.packets_inbound, row.unique_flow_count) == (9000, 6001)


def test_open_window_is_left_out(spark):
    rows = aggregate_rows(spark, [(0, 1, 1, 1), (1, 1, 1, 1), (5, 1, 1, 1)])
    open_last = rows.withColumn("timestamp_end", F.col("window_start"))
    assert closed_windows(open_last).count() == 2
    assert closed_windows(open_last, F.lit(START + timedelta(seconds=60))).count() == 3


ARRIVALS = [(1, 0), (2, 12), (3, 9), (4, 15), (5, 25), (6, 19), (7, 20), (8, 29.9), (9, 30)]


def arrivals(spark, rows=ARRIVALS, partition=0):
    made = [(n, START + timedelta(seconds=at), partition) for n, at in rows]
    return spark.createDataFrame(made, "offset BIGINT, timestamp TIMESTAMP, part INT")


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 1_000_000])
def test_late_records_are_dropped_exactly(spark, chunk_rows):
    kept = drop_late(arrivals(spark), chunk_rows=chunk_rows)
    assert sorted(r.offset for r in kept.collect()) == [1, 2, 4, 5, 7, 8, 9]
    assert kept.columns == ["offset", "timestamp", "part"]


def test_each_source_partition_has_its_own_stream_time(spark):
    ahead = arrivals(spark, [(1, 100), (2, 101)], partition=1)
    other = arrivals(spark, [(1, 0), (2, 1)], partition=None)
    rows = arrivals(spark).unionByName(ahead).unionByName(other)
    kept = drop_late(rows, source_partition="part", chunk_rows=2)
    assert kept.count() == 7 + 2 + 2


def test_records_without_a_position_are_an_error(spark):
    rows = arrivals(spark).unionByName(arrivals(spark, [(None, 5)]))
    with pytest.raises(Exception, match="no offset"):
        drop_late(rows, chunk_rows=2).count()


def test_running_matches_a_plain_window(spark):
    rows = spark.range(500).select(
        (F.col("id") % 3).alias("k"),
        F.col("id").alias("n"),
        F.when(F.col("id") % 7 != 0, F.xxhash64("id") % 1000).alias("v"),
    )
    rows.createOrReplaceTempView("sequence")
    measures = {"c": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    got = running(rows, ["k"], ["n"], F.floor(F.col("n") / 20), measures)
    expected = spark.sql(
        """SELECT k, n, v, count(v) OVER w c, sum(v) OVER w s, min(v) OVER w lo, max(v) OVER w hi
        FROM sequence WINDOW w AS (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING)"""
    )
    assert sorted(got.collect()) == sorted(expected.collect())
