import json
from datetime import timedelta

import pytest

from builders import START, packet_rows
from pyspark.sql import functions as F

from rillwatch.operators import (
    flow_report,
    microflow_aggregate,
    microflow_json,
    microflows_as_flows,
    packet_traffic,
    traffic_aggregate,
)
from rillwatch.plans import derived

NET, MASK = 0x0A2A0100, 0xFFFFFF00
LOCAL, REMOTE = 0x0A2A014D, 0xCB007109
FLOW = (LOCAL, REMOTE, 50123, 443, 6)


def test_counts_and_mean_gap(spark):
    packets = packet_rows(
        spark,
        [
            (1, 0.1, *FLOW, 10, 0x02),
            (2, 0.3, *FLOW, 0, 0x12),
            (3, 0.9, *FLOW, 500, 0x11),
            (4, 1.0, *FLOW, 5, 0x04),
        ],
    )
    first, second = microflow_aggregate(packets, NET, MASK).orderBy("tick_start").collect()
    assert (first.packets, first.bytes, first.min_size, first.max_size) == (3, 510, 0, 500)
    assert first.mean_iat_us == 400000.0
    assert first.tcp.asDict() == {"syn": 2, "ack": 2, "fin": 1, "rst": 0}
    assert first.dir == "OUTBOUND" and first.src_ip == "10.42.1.77"
    assert second.tick_start == START + timedelta(seconds=1)
    assert (second.packets, second.mean_iat_us, second.tcp.rst) == (1, 0.0, 1)


def test_mean_gap_follows_arrival_order(spark):
    packets = packet_rows(spark, [(1, 0.5, *FLOW, 1, 0), (2, 0.2, *FLOW, 1, 0), (3, 0.4, *FLOW, 1, 0)])
    assert microflow_aggregate(packets, NET, MASK).first().mean_iat_us == -50000.0
    assert microflow_aggregate(packets, NET, MASK, order=None).first().mean_iat_us == 150000.0


def test_flags_count_for_tcp_only(spark):
    udp = (LOCAL, REMOTE, 1, 2, 17)
    row = microflow_aggregate(packet_rows(spark, [(1, 0, *udp, 9, 0x1F)]), NET, MASK).first()
    assert sum(row.tcp) == 0 and row.protocol == "UDP"


def test_published_text(spark):
    packets = packet_rows(spark, [(1, 0.0, *FLOW, 1, 2), (2, 600000.25, *FLOW, 2, 16)])
    rows = microflow_aggregate(packets, NET, MASK, tick="100 days").select(microflow_json().alias("v"))
    text = rows.first().v
    assert list(json.loads(text)) == (
        "src_ip src_port dst_ip dst_port protocol dir packets bytes min_size max_size mean_iat_us tcp"
    ).split()
    assert '"mean_iat_us":600000250000.0,"tcp":{"syn":1,"ack":1,"fin":0,"rst":0}}' in text


def test_report_line(spark):
    packets = packet_rows(spark, [(1, 0.0, *FLOW, 1, 2), (2, 0.5, LOCAL, LOCAL, 1, 2, 17, 4, 0)])
    rows = flow_report(microflow_aggregate(packets, NET, MASK)).orderBy("dir").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("10.42.1.77:1 -> 10.42.1.77:2", "LAT", "UDP", 1, 4, "4/4", "0.0 us", "-"),
        ("10.42.1.77:50123 -> 203.0.113.9:443", "OUT", "TCP", 1, 1, "1/1", "0.0 us", "1/0/0/0"),
    ]


# means in microseconds whose shortest texts end in a 5 behind the tenths, exact ties among them
MEANS = (0.05, 0.15, 0.25, 0.35, 0.75, 0.95, 27601632.95, 17850374.85, 23509067.05, 5000000.25, 5000000.75, 0.96,
         -0.04, -0.05, -0.25, -17850374.85, 0.0, 2.0**58, 0.049999999999999996)


def test_means_are_rounded_as_they_are_printed(spark):
    gaps = [(1, 0.0, *FLOW, 1, 2), (2, 0.5, *FLOW, 2, 16)]
    flow = microflow_aggregate(packet_rows(spark, gaps), NET, MASK)
    means = flow.drop("mean_iat_us").crossJoin(spark.createDataFrame([(m,) for m in MEANS], "mean_iat_us DOUBLE"))
    texts = means.select("mean_iat_us", microflow_json().alias("value"))
    for mean, text in texts.collect():
        assert f'"mean_iat_us":{mean:.1f},"tcp"' in text
    report = flow_report(means).select("mean_iat").collect()
    assert sorted(r.mean_iat for r in report) == sorted(f"{mean:.1f} us" for mean in MEANS)


def test_totals_are_kept(spark, sf_dir):
    packets = derived.packets(derived.events_table(spark, sf_dir))
    flows = microflow_aggregate(packets, NET, MASK, tick="1 day")
    total = flows.agg(F.sum("packets"), F.sum("bytes")).first()
    assert tuple(total) == (packets.count(), packets.agg(F.sum("payload_size")).first()[0])


def test_short_way_needs_whole_ticks(spark):
    packets = packet_rows(spark, [(1, 0, *FLOW, 1, 0)])
    for tick, window in (("3 seconds", "10 seconds"), ("1 second", "1 month"), ("x", "10 seconds")):
        with pytest.raises(ValueError):
            packet_traffic(packets, NET, MASK, window=window, tick=tick)


def test_short_way_equals_the_way_through_microflows(spark, sf_dir):
    packets = derived.packets(derived.events_table(spark, sf_dir))
    args = (derived.LOCAL_NET, derived.LOCAL_MASK)
    for tick, window in (("10 minutes", "1 hour"), ("1 hour", "6 hours")):
        long = traffic_aggregate(microflows_as_flows(microflow_aggregate(packets, *args, tick=tick)), window)
        short = packet_traffic(packets, *args, window=window, tick=tick)
        assert long.exceptAll(short).count() == 0 and short.exceptAll(long).count() == 0
