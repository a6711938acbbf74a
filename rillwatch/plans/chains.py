"""The stages put together."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import (
    alert_messages,
    decode_frames,
    packet_traffic,
    rolling_anomalies,
    traffic_aggregate,
)
from ..schemas import TICK, WINDOW
from ..session import cut_lineage
from ..streaming.detector import stream_rolling_anomalies


def packets_to_warnings(
    packets: DataFrame,
    net: int,
    mask: int,
    tick: str = TICK,
    window: str = WINDOW,
    group_cols: Sequence[str] = (),
    **detection,
) -> DataFrame:
    """Packets to warnings, for all traffic or per group. The aggregates are stored in between.

    ``detection`` are the options of :func:`rillwatch.operators.rolling_anomalies`.
    """
    traffic = packet_traffic(packets, net, mask, window, tick, group_cols=group_cols)
    return rolling_anomalies(cut_lineage(traffic), **detection)


def frames_to_alerts(
    frames: DataFrame, net: int, mask: int, tick: str = TICK, window: str = WINDOW, **options
) -> DataFrame:
    """Captured frames to alert rows; ``options`` as for :func:`packets_to_warnings`."""
    return alert_messages(packets_to_warnings(decode_frames(frames), net, mask, tick, window, **options))


def flows_to_warnings(
    flows: DataFrame, window: str = WINDOW, group_cols: Sequence[str] = (), **detection
) -> DataFrame:
    """Parsed flows to warnings."""
    return rolling_anomalies(cut_lineage(traffic_aggregate(flows, window, group_cols)), **detection)


def stream_flows_to_warnings(
    flows: DataFrame,
    window: str = WINDOW,
    watermark: str = "0 seconds",
    group_cols: Sequence[str] = (),
    **detection,
) -> DataFrame:
    """One streaming query from flows to warnings: windows close, then each is checked."""
    traffic = traffic_aggregate(flows, window, group_cols, watermark=watermark)
    return stream_rolling_anomalies(traffic, **detection)
