"""Structured Streaming parts."""

from .batches import publish_batch, read_results, stored_batches
from .delivery import ReceiverDown, alert_job, dead_letters, deliver_once, delivered
from .detector import RollingDetector, detector_state, last_windows, stream_rolling_anomalies
from .jobs import aggregate_job, capture_job, limit_job, split_job, view_job, watch_job
from .late import on_time_job, stream_drop_late
from .metrics import MetricsRecorder, metric_totals
from .quarantine import quarantine_job
from .run import drain, read_table_stream, tap
from .supervise import supervise

__all__ = [
    "MetricsRecorder",
    "ReceiverDown",
    "RollingDetector",
    "aggregate_job",
    "alert_job",
    "capture_job",
    "dead_letters",
    "deliver_once",
    "delivered",
    "detector_state",
    "drain",
    "last_windows",
    "limit_job",
    "metric_totals",
    "on_time_job",
    "publish_batch",
    "quarantine_job",
    "read_results",
    "read_table_stream",
    "split_job",
    "stored_batches",
    "stream_drop_late",
    "stream_rolling_anomalies",
    "supervise",
    "tap",
    "view_job",
    "watch_job",
]
