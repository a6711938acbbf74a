import struct
from datetime import datetime

from pyspark.sql import functions as F

from rillwatch.functions import flags_text, ip_to_text, protocol_name, text_to_ip
from rillwatch.operators import classify_direction, decode_frames
from rillwatch.schemas import FRAMES

NET, MASK = 0x0A2A0100, 0xFFFFFF00
LOCAL, REMOTE = 0x0A2A014D, 0xCB007109


def frame(
    protocol=6,
    payload=7,
    vlan=False,
    version=4,
    ihl=5,
    offset=5,
    flags=0x12,
    ether=0x0800,
    total=None,
    src=LOCAL,
    dst=REMOTE,
):
    l4_length = offset * 4 if protocol == 6 else 8
    total = ihl * 4 + l4_length + payload if total is None else total
    data = bytes(12) + (struct.pack(">HH", 0x8100, 100) if vlan else b"") + struct.pack(">H", ether)
    data += struct.pack(">BBHHHBBHII", version << 4 | ihl, 0, total, 0, 0, 64, protocol, 0, src, dst)
    data += bytes((ihl - 5) * 4)
    if protocol == 6:
        data += struct.pack(">HHIIBBHHH", 50123, 443, 1, 2, offset << 4, flags, 0, 0, 0)
        data += bytes((offset - 5) * 4)
    else:
        data += struct.pack(">HHHH", 5353, 65535, payload + 8, 0)
    return data + bytes(max(payload, 0))


def decode(spark, *captures):
    rows = [
        (number, datetime(2024, 1, 1), len(data) if caplen is None else caplen, data)
        for number, (data, caplen) in enumerate(captures)
    ]
    packets = decode_frames(spark.createDataFrame(rows, FRAMES)).collect()
    return {row.pkt_seq: row for row in packets}


def test_fields(spark):
    row = decode(spark, (frame(), None))[0]
    assert (row.src_ip, row.dst_ip) == (LOCAL, REMOTE)
    assert (row.src_port, row.dst_port, row.protocol) == (50123, 443, 6)
    assert (row.payload_size, row.tcp_flags) == (7, 0x12)


def test_vlan_options_and_udp(spark):
    got = decode(
        spark,
        (frame(vlan=True), None),
        (frame(ihl=8, offset=9, payload=100), None),
        (frame(protocol=17, payload=33, vlan=True), None),
    )
    assert [got[n].payload_size for n in range(3)] == [7, 100, 33]
    assert (got[2].src_port, got[2].dst_port, got[2].tcp_flags) == (5353, 65535, 0)


def test_foreign_frames_are_dropped(spark):
    got = decode(
        spark,
        (frame(ether=0x86DD), None),
        (frame(ether=0x0806), None),
        (frame(version=6), None),
        (frame(protocol=1), None),
        (frame(), None),
    )
    assert set(got) == {4}


def test_short_captures_are_dropped_exactly_at_the_header_end(spark):
    tcp, udp, tagged = frame(payload=0), frame(protocol=17, payload=0), frame(payload=0, vlan=True)
    got = decode(
        spark,
        (tcp, 54),
        (tcp, 53),
        (udp, 42),
        (udp, 41),
        (tagged, 58),
        (tagged, 57),
        (tcp[:33], 33),
        (b"", 0),
    )
    assert set(got) == {0, 2, 4}


def test_negative_payload_is_zero(spark):
    got = decode(spark, (frame(total=20), None), (frame(protocol=17, total=21), None))
    assert [got[n].payload_size for n in range(2)] == [0, 0]


def test_direction(spark):
    rows = spark.createDataFrame(
        [(1, LOCAL, REMOTE), (2, REMOTE, LOCAL), (3, LOCAL, LOCAL + 1), (4, REMOTE, REMOTE)],
        "n INT, src_ip BIGINT, dst_ip BIGINT",
    )
    known = [r.dir for r in classify_direction(rows, NET, MASK).orderBy("n").collect()]
    assert known == ["OUTBOUND", "INBOUND", "LATERAL", "UNKNOWN"]
    assert {r.dir for r in classify_direction(rows, 0, 0).collect()} == {"UNKNOWN"}


def test_addresses(spark):
    rows = spark.createDataFrame(
        [("10.42.1.77",), ("255.255.255.255",), ("0.0.0.0",), ("1.2.3",), ("1.2.3.256",), ("01.2.3.4",), ("x",), (None,)],
        "text STRING",
    )
    number = text_to_ip(F.col("text"))
    got = rows.select("text", number.alias("n"), ip_to_text(number).alias("back")).collect()
    assert [r.n for r in got] == [170525005, 4294967295, 0, None, None, None, None, None]
    assert [r.back for r in got[:3]] == [r.text for r in got[:3]]


def test_protocol_and_flag_names(spark):
    row = spark.range(1).select(
        flags_text(F.lit(6), F.lit(0x3F)).alias("all"),
        flags_text(F.lit(6), F.lit(0x12)).alias("two"),
        flags_text(F.lit(6), F.lit(0)).alias("none"),
        flags_text(F.lit(17), F.lit(2)).alias("udp"),
        *[protocol_name(F.lit(n)).alias(f"p{n}") for n in (6, 17, 1)],
    ).first()
    assert row.all == "SYN ACK FIN RST PSH URG"
    assert (row.two, row.none, row.udp) == ("SYN ACK", "", None)
    assert (row.p6, row.p17, row.p1) == ("TCP", "UDP", "OTHER")
