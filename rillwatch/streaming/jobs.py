"""The long-running applications, each one streaming query from topic to topic.

``source`` and ``sink`` are the keyword arguments of :func:`rillwatch.sources.read_topic` and
:func:`rillwatch.sources.stream_topic`, for example
``{"fmt": "kafka", "kafka.bootstrap.servers": "..."}`` or ``{"fmt": "parquet", "path": "..."}``.
Lasting streams need a ``checkpoint``, and a restart with the same one goes on where the last run
stopped. Bound a micro-batch with ``maxOffsetsPerTrigger`` (Kafka) or ``maxFilesPerTrigger`` (files)
among the options of ``source``: detection holds the new windows of one key in memory.
"""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import (
    aggregate_records,
    decode_frames,
    limit_alerts,
    microflow_aggregate,
    microflow_records,
    summary_records,
    traffic_aggregate,
    warning_records,
)
from ..schemas import AGGREGATED_TOPIC, RAW_TOPIC, TICK, WARNINGS_TOPIC, WINDOW
from ..session import configure
from ..sources import (
    deliver_alerts,
    each_batch,
    read_aggregates,
    read_flows,
    read_topic,
    stream_topic,
)
from .detector import stream_rolling_anomalies
from .run import tap

Options = Mapping[str, object]


def _from_now(source: Options, checkpoint: str | None) -> dict:
    """Options that start at new records once and then follow the checkpoint."""
    options = {"starting": "latest", **source}
    if options["starting"] == "latest" and options.get("fmt", "kafka") != "kafka" and checkpoint:
        options.setdefault("position", f"{checkpoint.rstrip('/')}-position")
    return options


def capture_job(
    frames: DataFrame, net: int, mask: int, sink: Options, tick: str = TICK, watermark: str = "0 seconds"
) -> StreamingQuery:
    """Stream of captured frames to the raw topic."""
    configure(frames.sparkSession)
    packets = decode_frames(frames)
    flows = microflow_aggregate(packets, net, mask, tick=tick, watermark=watermark)
    return stream_topic(microflow_records(flows), RAW_TOPIC, **sink)


def aggregate_job(
    spark: SparkSession,
    source: Options,
    sink: Options,
    window: str = WINDOW,
    watermark: str = "0 seconds",
    group_cols: Sequence[str] = (),
) -> StreamingQuery:
    """Raw topic to aggregates topic: each window once, when it closes."""
    configure(spark)
    flows = tap(read_flows(spark, stream=True, **source), "parsed")
    traffic = traffic_aggregate(flows, window, group_cols=group_cols, watermark=watermark)
    return stream_topic(tap(aggregate_records(traffic), "emitted"), AGGREGATED_TOPIC, **sink)


def watch_job(spark: SparkSession, source: Options, sink: Options, **detection) -> StreamingQuery:
    """Aggregates topic to warnings topic."""
    configure(spark)
    aggregates = tap(read_aggregates(spark, stream=True, **source), "parsed")
    warnings = stream_rolling_anomalies(aggregates, **detection)
    return stream_topic(warning_records(warnings), WARNINGS_TOPIC, **sink)


def split_job(spark: SparkSession, source: Options, sink: Options) -> StreamingQuery:
    """Aggregates topic, new records, to the three summary topics."""
    configure(spark)
    aggregates = read_aggregates(spark, stream=True, **_from_now(source, sink.get("checkpoint")))
    return stream_topic(summary_records(aggregates), **sink)


def limit_job(
    spark: SparkSession,
    source: Options,
    write: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    available_now: bool = False,
    **limits: int,
) -> StreamingQuery:
    """Aggregates topic, new records, to alerts above fixed limits; ``write`` gets batch and number."""
    configure(spark)
    aggregates = read_aggregates(spark, stream=True, **_from_now(source, checkpoint))
    return each_batch(limit_alerts(aggregates, **limits), write, checkpoint, available_now)


def view_job(
    spark: SparkSession,
    source: Options,
    write: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Warnings topic, new records, to alert rows; ``write`` gets batch and number."""
    configure(spark)
    records = read_topic(spark, WARNINGS_TOPIC, stream=True, **_from_now(source, checkpoint))
    return deliver_alerts(records, write, checkpoint, available_now)
