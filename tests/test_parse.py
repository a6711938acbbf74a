import json

import pytest
from pyspark.sql import functions as F

from rillwatch.operators import (
    aggregate_json,
    flow_json,
    parse_aggregates,
    parse_flows,
    parse_rejects,
    parse_warnings,
    read_flow_json,
    warning_json,
)

GOOD = {
    "src_ip": "10.42.1.77",
    "src_port": 50123,
    "dst_ip": "203.0.113.9",
    "dst_port": 443,
    "protocol": "TCP",
    "dir": "OUTBOUND",
    "packets": 9,
    "bytes": 640,
    "min_size": 0,
    "max_size": 410,
    "mean_iat_us": 1234.5,
    "tcp": {"syn": 1, "ack": 8, "fin": 0, "rst": 0},
}


def without(*path):
    record = json.loads(json.dumps(GOOD))
    inner = record
    for name in path[:-1]:
        inner = inner[name]
    del inner[path[-1]]
    return record


def raw(spark, *values):
    texts = [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]
    rows = spark.createDataFrame(list(enumerate(texts)), "offset INT, value STRING")
    return rows.withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def flow(spark, **changes):
    return parse_flows(raw(spark, {**GOOD, **changes})).first()


def test_usual_record(spark):
    row = flow(spark)
    assert row.flow_key == "10.42.1.77:50123-203.0.113.9:443-TCP"
    assert (row.packet_count, row.byte_count, row.min_packet_size, row.max_packet_size) == (9, 640, 0, 410)
    assert (row.mean_iat_us, row.dir) == (1234.5, "OUTBOUND")
    assert (row.tcp_syn_count, row.tcp_ack_count, row.tcp_fin_count, row.tcp_rst_count) == (1, 8, 0, 0)
    assert row.ingest_time is not None


BROKEN = [
    "{bad",
    "",
    None,
    "[1]",
    "5",
    "null",
    json.dumps(GOOD)[:-1],
    json.dumps(GOOD).replace('"', "'"),
    json.dumps(GOOD).replace(": 9,", ": NaN,"),
    {**GOOD, "tcp": 5},
    {**GOOD, "tcp": None},
    {**GOOD, "tcp": []},
    {**GOOD, "protocol": "OTHER"},
    {**GOOD, "protocol": "tcp"},
    {**GOOD, "protocol": None},
    {**GOOD, "dir": "inbound"},
    {**GOOD, "dir": ["INBOUND"]},
    *[without(name) for name in GOOD],
    *[without("tcp", flag) for flag in GOOD["tcp"]],
]


def test_every_broken_record_is_rejected(spark):
    records = raw(spark, *BROKEN, GOOD)
    assert parse_flows(records).count() == 1
    rejected = [r.offset for r in parse_rejects(records).orderBy("offset").collect()]
    assert rejected == list(range(len(BROKEN)))
    assert parse_rejects(records).columns == records.columns


@pytest.mark.parametrize(
    "value, expected",
    [
        ("7", 7),
        (" 7 ", 7),
        ("+7", 7),
        ("7.9", 7),
        ("many", 0),
        ("true", 0),
        ("NaN", 0),
        ("", 0),
        (None, 0),
        (3.9, 3),
        (-3.9, -3),
        (1e3, 1000),
        (True, 1),
        (False, 0),
        ({"n": 1}, 0),
        ([4], 0),
        (3_000_000_000, 3_000_000_000),
        (1e30, 9_200_000_000_000_000_000),
    ],
)
def test_numbers_are_coerced(spark, value, expected):
    assert flow(spark, packets=value).packet_count == expected


def test_mean_is_coerced(spark):
    assert flow(spark, mean_iat_us="12.5").mean_iat_us == 12.5
    assert flow(spark, mean_iat_us=True).mean_iat_us == 1.0
    assert flow(spark, mean_iat_us=None).mean_iat_us == 0.0


def test_flag_counts_are_coerced(spark):
    row = flow(spark, tcp={"syn": True, "ack": "4", "fin": None, "rst": 2.5, "more": 1})
    assert (row.tcp_syn_count, row.tcp_ack_count, row.tcp_fin_count, row.tcp_rst_count) == (1, 4, 0, 2)


def test_addresses(spark):
    assert flow(spark, src_ip=None).src_ip is None
    assert flow(spark, src_ip=None).flow_key.startswith("null:50123-")
    assert flow(spark, src_ip=5).src_ip == "5"
    assert flow(spark, src_ip={"a": 1}).src_ip == ""
    assert flow(spark, src_ip="{a").src_ip == "{a"


def test_extra_keys_are_ignored(spark):
    assert flow(spark, extra={"a": [1]}).packet_count == 9


def test_flow_record_round_trip(spark):
    flows = parse_flows(raw(spark, GOOD)).drop("ingest_time")
    for time, text in (
        ("2024-01-02 03:04:05.000006", "[2024,1,2,3,4,5,6000]"),
        ("2024-01-02 03:04:05", "[2024,1,2,3,4,5]"),
        ("2024-01-02 03:04:00", "[2024,1,2,3,4]"),
        ("2024-01-02 03:04:00.5", "[2024,1,2,3,4,0,500000000]"),
    ):
        timed = flows.withColumn("timestamp", F.lit(time).cast("timestamp"))
        written = timed.select(flow_json().alias("value"))
        assert f'"timestamp":{text}' in written.first().value
        assert read_flow_json(written).collect() == timed.select(*read_flow_json(written).columns).collect()


@pytest.mark.parametrize("text", ["{bad", '{"packet_count":"x"}', '{"surprise":1}'])
def test_bad_flow_record_raises(spark, text):
    with pytest.raises(Exception):
        read_flow_json(spark.createDataFrame([(text,)], "value STRING")).collect()


def test_flow_record_is_read_by_its_types_and_judged_only_if_it_differs(spark):
    flows = parse_flows(raw(spark, GOOD)).withColumn("mean_iat_us", F.lit(-0.0))
    written = flows.select(flow_json().alias("value"))
    read = read_flow_json(written)
    assert str(read.first().mean_iat_us) == "-0.0"
    text = read._jdf.queryExecution().executedPlan().toString()
    assert "from_json" in text and "CASE WHEN NOT _same" in text
    for bad in ('"packet_count":"x",', '"packet_count":1,"surprise":1,'):
        wrong = F.replace("value", F.lit('"packet_count":9,'), F.lit(bad)).alias("value")
        assert bad in written.select(wrong).first().value
        with pytest.raises(Exception):
            read_flow_json(written.select(wrong)).collect()
    other = F.replace("value", F.lit('"packet_count":'), F.lit(' "packet_count": ')).alias("value")
    assert read_flow_json(written.select(other)).first() == read.first()


def test_missing_flow_record_fields_have_defaults(spark):
    row = read_flow_json(spark.createDataFrame([('{"src_ip":"a"}',)], "value STRING")).first()
    assert (row.src_ip, row.packet_count, row.timestamp, row.mean_iat_us) == ("a", 0, None, 0.0)


def aggregates(spark, *values):
    rows = raw(spark, *values).withColumn("key", F.lit("k"))
    return parse_aggregates(rows).collect()


def test_empty_aggregate_round_trip(spark):
    text = (
        '{"timestamp_start":"2024-01-01T00:00:01.234","timestamp_end":null,"bytes_inbound":0,'
        '"averagePacketSize":0.0,"flowKeys":["a"]}'
    )
    row = aggregates(spark, text)[0]
    assert row.timestamp_start.microsecond == 234000
    assert (row.timestamp_end, row.bytes_inbound, row.unique_flow_count) == (None, 0, 0)
    assert row.window_start == row.timestamp_start and row.average_packet_size == 0.0
    again = spark.createDataFrame([row], parse_aggregates(raw(spark).withColumn("key", F.lit("k"))).schema)
    written = again.select(aggregate_json().alias("v")).first().v
    assert '"timestamp_start":"2024-01-01T00:00:01.234","timestamp_end":null' in written


def test_aggregate_acceptance(spark):
    good = [
        {"bytes_inbound": "7"},
        {"bytes_inbound": ""},
        {"bytes_inbound": 7.9},
        {"bytes_inbound": None},
        {},
        {"timestamp_end": ""},
    ]
    bad = [
        {"bytes_inbound": "7.9"},
        {"bytes_inbound": "x"},
        {"bytes_inbound": True},
        {"bytes_inbound": [1]},
        {"timestamp_start": "yesterday"},
        {"timestamp_start": 5},
        "[]",
        "null",
        "{bad",
        None,
    ]
    assert [r.bytes_inbound for r in aggregates(spark, *good)] == [7, 0, 7, 0, 0, 0]
    assert aggregates(spark, *bad) == []


def test_warnings(spark):
    good = [
        {"severidade": "alta", "descricao": "x"},
        {"severidade": None},
        {},
        {"severidade": 7, "descricao": True},
    ]
    bad = [{"severidade": "alta", "extra": 1}, {"severidade": {}}, {"descricao": []}, "null", "[1]", "{", "", None]
    got = [tuple(r) for r in parse_warnings(raw(spark, *good, *bad)).collect()]
    assert got == [("alta", "x"), (None, None), (None, None), ("7", "true")]
    written = parse_warnings(raw(spark, good[0])).select(warning_json().alias("v")).first().v
    assert written == '{"severidade":"alta","descricao":"x"}'
