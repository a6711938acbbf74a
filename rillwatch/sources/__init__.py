"""Readers and writers of topics."""

from .sinks import deliver_alerts, each_batch, stream_topic, write_topic
from .topics import (
    in_file_order,
    read_aggregates,
    read_flows,
    read_frames,
    read_packets,
    read_topic,
    read_warnings,
)

__all__ = [
    "deliver_alerts",
    "each_batch",
    "in_file_order",
    "read_aggregates",
    "read_flows",
    "read_frames",
    "read_packets",
    "read_topic",
    "read_warnings",
    "stream_topic",
    "write_topic",
]
