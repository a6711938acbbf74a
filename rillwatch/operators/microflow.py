"""Packets to microflows: one row per connection and tick."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import ip_to_text
from ..functions.numbers import micros_between, one_decimal, one_decimal_text, signed_zero
from ..functions.packets import (
    ACK,
    FIN,
    RST,
    SYN,
    direction,
    flag_count,
    protocol_name,
    short_direction,
)
from ..schemas import FIVE_TUPLE, TICK


def microflow_aggregate(
    packets: DataFrame,
    net: int,
    mask: int,
    tick: str = TICK,
    watermark: str | None = None,
    order: str | None = "pkt_seq",
) -> DataFrame:
    """Volume, payload range, mean inter-arrival time and flag counts per 5-tuple and tick.

    The inter-arrival times of ``n`` packets in arrival order add up to last minus first
    timestamp, so the mean needs no window over the packets and every part combines map-side.
    ``order`` names the arrival order; ``None`` takes the timestamps as that order.
    ``watermark`` gives the streaming form.
    """
    rows = packets if watermark is None else packets.withWatermark("ts", watermark)
    protocol, flags = F.col("protocol"), F.col("tcp_flags")
    first = F.min("ts") if order is None else F.min_by("ts", order)
    last = F.max("ts") if order is None else F.max_by("ts", order)
    flows = rows.groupBy(F.window("ts", tick).alias("tick"), *FIVE_TUPLE).agg(
        F.count("*").alias("packets"),
        F.sum("payload_size").alias("bytes"),
        F.min("payload_size").cast("int").alias("min_size"),
        F.max("payload_size").cast("int").alias("max_size"),
        first.alias("first_seen"),
        last.alias("last_seen"),
        flag_count(protocol, flags, SYN).alias("syn"),
        flag_count(protocol, flags, ACK).alias("ack"),
        flag_count(protocol, flags, FIN).alias("fin"),
        flag_count(protocol, flags, RST).alias("rst"),
    )
    gaps = F.col("packets") - 1
    elapsed = micros_between(F.col("first_seen"), F.col("last_seen")).cast("double")
    return flows.select(
        F.col("tick.start").alias("tick_start"),
        ip_to_text(F.col("src_ip")).alias("src_ip"),
        "src_port",
        ip_to_text(F.col("dst_ip")).alias("dst_ip"),
        "dst_port",
        protocol_name(protocol).alias("protocol"),
        direction(F.col("src_ip"), F.col("dst_ip"), net, mask).alias("dir"),
        "packets",
        "bytes",
        "min_size",
        "max_size",
        F.when(gaps > 0, elapsed / gaps).otherwise(F.lit(0.0)).alias("mean_iat_us"),
        F.struct("syn", "ack", "fin", "rst").alias("tcp"),
    )


def microflow_json() -> Column:
    """The published text of a microflow; the mean has one decimal place."""
    text = F.to_json(
        F.struct(
            "src_ip",
            "src_port",
            "dst_ip",
            "dst_port",
            "protocol",
            "dir",
            "packets",
            "bytes",
            "min_size",
            "max_size",
            one_decimal(F.col("mean_iat_us")).alias("mean_iat_us"),
            "tcp",
        )
    )
    return signed_zero(text, "mean_iat_us", F.col("mean_iat_us"))


def microflow_records(microflows: DataFrame) -> DataFrame:
    """Records for the raw topic: no key, JSON value, the tick as timestamp."""
    return microflows.select(
        F.lit(None).cast("string").alias("key"),
        microflow_json().alias("value"),
        F.col("tick_start").alias("timestamp"),
    )


def microflows_as_flows(microflows: DataFrame) -> DataFrame:
    """Microflow rows under the column names of parsed flows, without the JSON detour."""
    return microflows.select(
        "src_ip",
        "src_port",
        "dst_ip",
        "dst_port",
        "protocol",
        "dir",
        F.col("packets").alias("packet_count"),
        F.col("bytes").alias("byte_count"),
        F.col("min_size").alias("min_packet_size"),
        F.col("max_size").alias("max_packet_size"),
        F.col("tick_start").alias("timestamp"),
        "mean_iat_us",
        F.col("tcp.syn").alias("tcp_syn_count"),
        F.col("tcp.fin").alias("tcp_fin_count"),
        F.col("tcp.rst").alias("tcp_rst_count"),
        F.col("tcp.ack").alias("tcp_ack_count"),
    )


def flow_report(microflows: DataFrame) -> DataFrame:
    """The columns of the printed flow table."""
    counts = [F.col(f"tcp.{name}").cast("string") for name in ("syn", "ack", "fin", "rst")]
    return microflows.select(
        "tick_start",
        F.format_string("%s:%d -> %s:%d", "src_ip", "src_port", "dst_ip", "dst_port").alias("flow"),
        short_direction(F.col("dir")).alias("dir"),
        "protocol",
        "packets",
        "bytes",
        F.concat_ws("/", F.col("min_size").cast("string"), F.col("max_size").cast("string")).alias(
            "min_max"
        ),
        F.concat(one_decimal_text(F.col("mean_iat_us")), F.lit(" us")).alias("mean_iat"),
        F.when(F.col("protocol") == "TCP", F.concat_ws("/", *counts))
        .otherwise("-")
        .alias("tcp_flags"),
    )
