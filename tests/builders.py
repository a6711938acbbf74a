"""Small hand-made inputs."""

from datetime import datetime, timedelta

from rillwatch.schemas import AGGREGATES, PACKETS

START = datetime(2024, 1, 1)


def packet_rows(spark, rows):
    """Rows of (seq, seconds, src_ip, dst_ip, src_port, dst_port, protocol, payload, flags)."""
    timed = [(seq, START + timedelta(seconds=at), *rest) for seq, at, *rest in rows]
    return spark.createDataFrame(timed, PACKETS)


def flow_rows(spark, rows):
    """Rows of (seconds, src_ip, src_port, dst_ip, dst_port, protocol, dir, packets, bytes[, syn])."""
    timed = [
        (START + timedelta(seconds=at), *rest[:8], rest[8] if len(rest) > 8 else 0, 0, 0, 0)
        for at, *rest in rows
    ]
    return spark.createDataFrame(
        timed,
        "timestamp TIMESTAMP, src_ip STRING, src_port BIGINT, dst_ip STRING, dst_port BIGINT,"
        " protocol STRING, dir STRING, packet_count BIGINT, byte_count BIGINT,"
        " tcp_syn_count BIGINT, tcp_ack_count BIGINT, tcp_fin_count BIGINT, tcp_rst_count BIGINT",
    )


def aggregate_rows(spark, rows, key="k", seconds=10):
    """Rows of (window number, bytes in, bytes out, flows)."""
    made = []
    for number, bytes_in, bytes_out, flows, *own_key in rows:
        start = START + timedelta(seconds=seconds * number)
        end = start + timedelta(seconds=seconds)
        made.append(
            (own_key[0] if own_key else key, start, end, start, end, bytes_in, bytes_out, 0, 0, flows, 0, 0, 0, 0, 0.0)
        )
    return spark.createDataFrame(made, AGGREGATES)
