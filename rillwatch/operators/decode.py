"""Captured Ethernet frames to packet rows, with binary built-ins only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import with_once
from ..functions.packets import TCP, UDP, direction

# fixed values: EtherTypes and header lengths in bytes
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_VLAN = 0x8100
ETHERNET_HEADER = 14
VLAN_TAG = 4
IPV4_HEADER = 20
TCP_HEADER = 20
UDP_HEADER = 8


def _number(offset, length: int) -> Column:
    """Big-endian unsigned integer of at most 7 bytes at a 0-based offset of the frame."""
    start = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(F.col("frame"), start + 1, F.lit(length))
    return F.conv(F.hex(part), 16, 10).cast("bigint")


def decode_frames(frames: DataFrame) -> DataFrame:
    """IPv4 TCP/UDP packets of ``frames`` (pkt_seq, ts, caplen, frame); everything else is dropped.

    One VLAN tag is skipped. A capture too short for its IP or transport header is dropped.
    The payload is what the IP total length leaves after both headers, never below zero.
    Neighbouring header fields are read as one number and taken apart with shifts, so a packet
    costs six byte conversions.
    """
    # No kept packet has fewer bytes than this, and it makes the reads below complete.
    whole = frames.select("pkt_seq", "ts", "caplen", "frame").where(
        F.col("caplen") >= ETHERNET_HEADER + IPV4_HEADER
    )
    tagged = F.shiftright("link", 32) == ETHERTYPE_VLAN
    inner_type = F.col("link").bitwiseAND(F.lit(0xFFFF))
    linked = (
        with_once(whole, _number(12, 6).alias("link"))
        .withColumn("ether_type", F.when(tagged, inner_type).otherwise(F.shiftright("link", 32)))
        .withColumn("ip_at", F.when(tagged, ETHERNET_HEADER + VLAN_TAG).otherwise(ETHERNET_HEADER))
    )
    ip_at = F.col("ip_at")
    ipv4 = linked.where(
        (F.col("ether_type") == ETHERTYPE_IPV4) & (F.col("caplen") >= ip_at + IPV4_HEADER)
    )
    addressed = (
        with_once(
            ipv4,
            _number(ip_at, 4).alias("head"),
            _number(ip_at + 9, 7).alias("middle"),
            _number(ip_at + 16, 4).alias("dst_ip"),
        )
        .withColumn("version", F.shiftright("head", 28))
        .withColumn("ip_length", F.shiftright("head", 24).bitwiseAND(F.lit(15)).cast("int") * 4)
        .withColumn("protocol", F.shiftright("middle", 48).cast("int"))
        .withColumn("port_at", ip_at + F.col("ip_length"))
    )
    is_tcp = F.col("protocol") == TCP
    needed = F.col("port_at") + F.when(is_tcp, TCP_HEADER).otherwise(UDP_HEADER)
    kept = addressed.where(
        (F.col("version") == 4) & F.col("protocol").isin(TCP, UDP) & (F.col("caplen") >= needed)
    )
    ported = kept.withColumn("ports", _number(F.col("port_at"), 4)).withColumn(
        "control", F.when(is_tcp, _number(F.col("port_at") + 12, 2)).otherwise(F.lit(0))
    )
    transport = F.when(is_tcp, F.shiftright("control", 12) * 4).otherwise(UDP_HEADER)
    total = F.col("head").bitwiseAND(F.lit(0xFFFF))
    return ported.select(
        "pkt_seq",
        "ts",
        F.col("middle").bitwiseAND(F.lit(0xFFFFFFFF)).alias("src_ip"),
        "dst_ip",
        F.shiftright("ports", 16).cast("int").alias("src_port"),
        F.col("ports").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("dst_port"),
        "protocol",
        F.greatest(F.lit(0).cast("bigint"), total - F.col("ip_length") - transport).alias("payload_size"),
        F.col("control").bitwiseAND(F.lit(0xFF)).cast("int").alias("tcp_flags"),
    )


def classify_direction(
    df: DataFrame, net: int, mask: int, src: str = "src_ip", dst: str = "dst_ip"
) -> DataFrame:
    """Add ``dir`` relative to the local network."""
    return df.withColumn("dir", direction(F.col(src), F.col(dst), net, mask))
