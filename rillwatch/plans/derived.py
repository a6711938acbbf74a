"""Network tables derived from the ``events`` table by integer arithmetic.

The given tables hold no network data; every event becomes one packet, frame or topic record, so
the work grows with the table. Events are minutes apart, so ticks are 10 minutes and windows 1 hour.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.addresses import ip_to_text
from ..functions.once import with_once
from ..functions.packets import direction, protocol_name
from ..schemas import layout
from ..session import configure

# the local network 10.42.1.0/24 and a remote one
LOCAL_NET = 170524928
LOCAL_MASK = 4294967040
REMOTE_NET = 3639549952
TICK = "10 minutes"
WINDOW = "1 hour"
SNAPLEN = 128

EVENTS = layout(
    event_id=T.LongType(),
    ts=T.TimestampNTZType(),
    user_id=T.LongType(),
    event_type=T.StringType(),
    value=T.DoubleType(),
    props=T.StringType(),
)


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with its time as TIMESTAMP; the session zone is UTC, so values stay the same."""
    return with_event_time(configure(spark).read.parquet(f"{sf_dir}/events.parquet"))


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _address(local_types: tuple[str, ...], host: Column) -> Column:
    local = F.col("event_type").isin(*local_types)
    return F.when(local, F.lit(LOCAL_NET) + host % 8).otherwise(F.lit(REMOTE_NET) + host % 8)


def _source() -> Column:
    return _address(("click", "purchase", "signup"), F.col("user_id")).cast("bigint")


def _target() -> Column:
    return _address(("view", "purchase"), F.col("user_id") + 3).cast("bigint")


def _payload() -> Column:
    return F.floor(F.col("value") * 10).cast("bigint") % 1461


def packets(events: DataFrame) -> DataFrame:
    """One packet per event: 16 source ports, TCP with changing flags, every fifth UDP."""
    udp = F.col("event_id") % 5 == 0
    return events.select(
        F.col("event_id").alias("pkt_seq"),
        "ts",
        _source().alias("src_ip"),
        _target().alias("dst_ip"),
        (F.lit(40000) + F.col("user_id") % 16).cast("int").alias("src_port"),
        F.lit(443).alias("dst_port"),
        F.when(udp, 17).otherwise(6).alias("protocol"),
        _payload().alias("payload_size"),
        F.when(udp, F.lit(0)).otherwise(F.col("event_id") % 32).cast("int").alias("tcp_flags"),
    )


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def frames(events: DataFrame) -> DataFrame:
    """One Ethernet frame per event: VLAN tags, IP and TCP options, foreign protocols, short
    captures and impossible lengths all occur."""
    seq = F.col("event_id")
    link = F.when(seq % 23 == 0, "86DD").when(seq % 29 == 0, "0806").otherwise("0800")
    tag = F.when(seq % 7 == 0, "81000064").otherwise("")
    version = F.when(seq % 31 == 0, "6").otherwise("4")
    ip_words = F.when(seq % 11 == 0, 6).otherwise(5)
    protocol = F.when(seq % 41 == 0, 1).when(seq % 5 == 0, 17).otherwise(6)
    tcp_words = F.when(seq % 3 == 0, 8).otherwise(5)
    transport = F.when(protocol == 6, tcp_words * 4).otherwise(8)
    total = F.when(seq % 37 == 0, 20).otherwise(ip_words * 4 + transport + _payload())
    ip_header = F.concat(
        version,
        _hex(ip_words, 1),
        F.lit("00"),
        _hex(total, 4),
        F.lit("0001000040"),
        _hex(protocol, 2),
        F.lit("0000"),
        _hex(_source(), 8),
        _hex(_target(), 8),
        F.when(ip_words == 6, "01010101").otherwise(""),
    )
    ports = F.concat(_hex(F.lit(40000) + F.col("user_id") % 16, 4), _hex(F.lit(443), 4))
    tcp_header = F.concat(
        ports,
        F.lit("0000000A0000000B"),
        _hex(tcp_words, 1),
        F.lit("0"),
        _hex(seq % 256, 2),
        F.lit("FFFF00000000"),
        F.when(tcp_words == 8, F.repeat(F.lit("01"), 12)).otherwise(""),
    )
    udp_header = F.concat(ports, _hex(_payload() + 8, 4), F.lit("0000"))
    whole = F.concat(
        F.lit("020000000001020000000002"),
        tag,
        link,
        ip_header,
        F.when(protocol == 6, tcp_header).otherwise(udp_header),
        F.repeat(F.lit("AB"), SNAPLEN),
    )
    kept = F.when(seq % 43 == 0, 40).when(seq % 47 == 0, 30).otherwise(SNAPLEN)
    frame = F.unhex(F.substring(whole, F.lit(1), kept * 2)).alias("frame")
    return with_once(events, frame).select(seq.alias("pkt_seq"), "ts", kept.alias("caplen"), "frame")


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def raw_records(events: DataFrame) -> DataFrame:
    """One raw-topic record per event; some break a rule of the parse contract, each in one way."""
    seq = F.col("event_id")
    case = seq % 40
    way = direction(_source(), _target(), LOCAL_NET, LOCAL_MASK)
    count = (seq % 50).cast("string")
    packets_text = (
        F.when(case == 11, F.concat(F.lit('"'), count, F.lit('"')))
        .when(case == 12, "null")
        .when(case == 13, F.concat(count, F.lit(".9")))
        .when(case == 14, "true")
        .when(case == 15, '"many"')
        .when(case == 16, '{"n":1}')
        .otherwise(count)
    )
    protocol = F.when(case == 8, "OTHER").otherwise(
        protocol_name(F.when(seq % 5 == 0, 17).otherwise(6))
    )
    flag = {bit: F.when(seq % 5 == 0, 0).otherwise(F.floor(seq / bit) % 2) for bit in (1, 2, 4, 16)}
    tcp = F.when(case == 6, "5").otherwise(
        F.concat(
            F.lit("{"),
            F.when(case == 7, "").otherwise(_joined('"syn":', flag[2], ",")),
            _joined('"ack":', flag[16], ',"fin":', flag[1], ',"rst":', flag[4], "}"),
        )
    )
    text = F.concat(
        F.when(case == 10, '{"extra":[1,2],').otherwise("{"),
        F.lit('"src_ip":'),
        F.when(case == 17, "null").otherwise(F.concat(F.lit('"'), ip_to_text(_source()), F.lit('"'))),
        _joined(',"src_port":', F.lit(40000) + F.col("user_id") % 16, ',"dst_ip":"'),
        ip_to_text(_target()),
        F.lit('","dst_port":443,"protocol":"'),
        protocol,
        F.lit('","dir":"'),
        F.when(case == 9, F.lower(way)).otherwise(way),
        F.lit('","packets":'),
        packets_text,
        _joined(',"bytes":', _payload(), ',"min_size":', seq % 9, ","),
        F.when(case == 5, "").otherwise(_joined('"max_size":', seq % 9 + 100, ",")),
        _joined('"mean_iat_us":', seq % 1000, ".", seq % 10, ',"tcp":'),
        tcp,
        F.lit("}"),
    )
    value = (
        F.when(case == 1, "{bad")
        .when(case == 2, "")
        .when(case == 3, F.lit(None).cast("string"))
        .when(case == 4, "[1]")
        .otherwise(text)
    )
    return events.select(
        F.lit(None).cast("string").alias("key"),
        value.alias("value"),
        seq.alias("offset"),
        F.col("ts").alias("timestamp"),
    )


def arrivals(events: DataFrame) -> DataFrame:
    """Packet sequence with every tenth record arriving 60 places late."""
    seq = F.col("event_id")
    return events.select(
        seq.alias("pkt_seq"),
        (seq + F.when(seq % 10 == 0, 60).otherwise(0)).alias("arrival"),
        (F.col("user_id") % 3).cast("int").alias("source_partition"),
        F.col("ts").alias("timestamp"),
    )


def warning_topic(events: DataFrame) -> DataFrame:
    """One warnings-topic record per event, readable and unreadable ones."""
    seq = F.col("event_id")
    case = seq % 12
    name = (
        F.when(case == 0, '"alta"')
        .when(case == 1, '"MEDIA"')
        .when(case == 2, '"regular"')
        .when(case == 3, '"outra"')
        .when(case == 4, "null")
        .when(case == 5, "7")
        .when(case == 6, '{"x":1}')
        .otherwise('"Alta"')
    )
    text = F.concat(
        F.lit('{"severidade":'),
        name,
        _joined(',"descricao":"evento ', seq, '"'),
        F.when(case == 7, ',"extra":1}').when(case == 8, "").otherwise("}"),
    )
    value = F.when(case == 9, "null").when(case == 10, '["alta"]').otherwise(text)
    return events.select(seq.alias("offset"), value.alias("value"), F.col("ts").alias("timestamp"))
