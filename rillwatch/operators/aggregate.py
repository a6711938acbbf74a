"""Flows to traffic aggregates: one row per group and tumbling window."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import ip_to_text
from ..functions.durations import micros
from ..functions.keys import group_key, joined_identity
from ..functions.numbers import total, wide
from ..functions.packets import ACK, FIN, RST, SYN, direction, flag_count, protocol_name
from ..schemas import AGGREGATE_SUMS, AGGREGATES, FIVE_TUPLE, TICK, WINDOW


def average_packet_size() -> Column:
    packets = wide(F.col("packets_inbound")) + wide(F.col("packets_outbound"))
    volume = wide(F.col("bytes_inbound")) + wide(F.col("bytes_outbound"))
    mean = volume.cast("double") / packets.cast("double")
    return F.when(packets == 0, F.lit(0.0)).otherwise(mean)


def _finish(per_flow: DataFrame) -> DataFrame:
    """Second step: one row per (window, key, flow) becomes one row per (window, key).

    Each flow is one input row here, so counting rows counts distinct flows exactly.
    """
    totals = per_flow.groupBy("window", "key").agg(
        F.min("timestamp_start").alias("timestamp_start"),
        F.max("timestamp_end").alias("timestamp_end"),
        *[total(F.col(name)).alias(name) for name in AGGREGATE_SUMS],
        F.count("*").alias("unique_flow_count"),
    )
    return (
        totals.withColumn("window_start", F.col("window.start"))
        .withColumn("window_end", F.col("window.end"))
        .withColumn("average_packet_size", average_packet_size())
        .select(*AGGREGATES.names)
    )


def _volume(name: str, wanted: str) -> Column:
    return total(F.when(F.col("dir") == wanted, F.col(name)).otherwise(F.lit(0)))


def traffic_aggregate(
    flows: DataFrame,
    window: str = WINDOW,
    group_cols: Sequence[str] = (),
    key_mode: str = "tuple",
    watermark: str | None = None,
    time: str = "timestamp",
) -> DataFrame:
    """Directional volume, TCP flag totals and exact distinct flows per window.

    Only INBOUND and OUTBOUND flows add volume; every direction adds flags and distinct flows.
    Rows are first combined per (window, key, flow), then per (window, key). Both steps combine
    map-side, the first spreads a busy window over all tasks by flow, and the same two steps run
    as a stream, where no state row ever holds a set of flows.

    ``group_cols`` splits the single global group. ``key_mode="concat"`` identifies a flow by its
    parts written without separators, which merges some different flows. ``watermark`` gives the
    streaming form; run it in append mode to get each window once, when it closes.
    """
    rows = flows if watermark is None else flows.withWatermark(time, watermark)
    if key_mode == "tuple":
        identity = [F.col(name).alias(f"flow_{name}") for name in FIVE_TUPLE]
    elif key_mode == "concat":
        identity = [joined_identity().alias("flow_identity")]
    else:
        raise ValueError(f"key_mode must be 'tuple' or 'concat', not {key_mode!r}")
    per_flow = rows.groupBy(
        F.window(time, window).alias("window"), group_key(group_cols).alias("key"), *identity
    ).agg(
        F.min(time).alias("timestamp_start"),
        F.max(time).alias("timestamp_end"),
        _volume("byte_count", "INBOUND").alias("bytes_inbound"),
        _volume("byte_count", "OUTBOUND").alias("bytes_outbound"),
        _volume("packet_count", "INBOUND").alias("packets_inbound"),
        _volume("packet_count", "OUTBOUND").alias("packets_outbound"),
        *[
            F.coalesce(total(F.col(f"tcp_{flag}_count")), F.lit(0)).alias(f"tcp_{flag}_total")
            for flag in ("syn", "ack", "fin", "rst")
        ],
    )
    return _finish(per_flow)


def packet_traffic(
    packets: DataFrame,
    net: int,
    mask: int,
    window: str = WINDOW,
    tick: str = TICK,
    watermark: str | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Traffic aggregates straight from packets, equal to aggregating their microflows.

    The window must be a whole number of ticks. The microflow step then only regroups what the
    window sums anyway, so leaving it out saves the largest shuffle of the chain. ``group_cols`` are
    parts of a flow or its direction, as microflows have them (addresses and protocols as text).
    """
    if micros(window) % micros(tick):
        raise ValueError(f"window {window!r} is not a whole number of ticks of {tick!r}")
    rows = packets if watermark is None else packets.withWatermark("ts", watermark)
    protocol, flags = F.col("protocol"), F.col("tcp_flags")
    flow = rows.groupBy(
        F.window("ts", window).alias("window"), *FIVE_TUPLE
    ).agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count("*").alias("packets"),
        total(F.col("payload_size")).alias("bytes"),
        *[
            flag_count(protocol, flags, bit).alias(f"tcp_{flag}_total")
            for flag, bit in (("syn", SYN), ("ack", ACK), ("fin", FIN), ("rst", RST))
        ],
    )
    way = direction(F.col("src_ip"), F.col("dst_ip"), net, mask)
    # the key is decided per flow: it only needs what all packets of a flow share
    named = flow.withColumns(
        {
            "dir": way,
            "src_ip": ip_to_text(F.col("src_ip")),
            "dst_ip": ip_to_text(F.col("dst_ip")),
            "protocol": protocol_name(protocol),
        }
    )
    sides = [
        F.when(F.col("dir") == wanted, F.col(name)).otherwise(F.lit(0)).alias(f"{name}_{wanted.lower()}")
        for name in ("bytes", "packets")
        for wanted in ("INBOUND", "OUTBOUND")
    ]
    # microflows carry the start of their tick
    per_flow = named.select(
        "window",
        group_key(group_cols).alias("key"),
        F.window("first_seen", tick)["start"].alias("timestamp_start"),
        "last_seen",
        *sides,
        *[f"tcp_{flag}_total" for flag in ("syn", "ack", "fin", "rst")],
    ).select("*", F.window("last_seen", tick)["start"].alias("timestamp_end"))
    return _finish(per_flow)


def closed_windows(aggregates: DataFrame, stream_time: Column | None = None) -> DataFrame:
    """Rows of windows that stream time has passed; the window still open is left out.

    Stream time is the latest flow seen. By default it comes from ``timestamp_end`` of the
    aggregates themselves, which are then read twice: pass a stored table.
    """
    if stream_time is None:
        stream_time = aggregates.select(F.max("timestamp_end")).scalar()
    return aggregates.where(F.col("window_end") <= stream_time)
