"""DataFrame operators of the pipeline."""

from .aggregate import average_packet_size, closed_windows, packet_traffic, traffic_aggregate
from .arrival import drop_late
from .decode import classify_direction, decode_frames
from .detect import (
    expanding_stats,
    limit_alerts,
    rolling_anomalies,
    rolling_means,
    rolling_sample,
    severity,
    unpivot_metrics,
)
from .microflow import (
    flow_report,
    microflow_aggregate,
    microflow_json,
    microflow_records,
    microflows_as_flows,
)
from .parse import (
    accepted_aggregates,
    accepted_flows,
    judge_aggregates,
    judge_flows,
    parse_aggregates,
    parse_flows,
    parse_rejects,
    parse_warnings,
    rejected_records,
)
from .route import (
    alert_messages,
    branch_by_prefix,
    flow_rows,
    split_metrics,
    summary_records,
    volume_rows,
)
from .serialize import (
    aggregate_json,
    aggregate_records,
    flow_json,
    read_flow_json,
    warning_json,
    warning_records,
)
from .sketch import estimated_flows, flow_sketches, union_sketches, within_error

__all__ = [
    "accepted_aggregates",
    "accepted_flows",
    "aggregate_json",
    "aggregate_records",
    "alert_messages",
    "average_packet_size",
    "branch_by_prefix",
    "classify_direction",
    "closed_windows",
    "decode_frames",
    "drop_late",
    "estimated_flows",
    "expanding_stats",
    "flow_json",
    "flow_report",
    "flow_rows",
    "flow_sketches",
    "judge_aggregates",
    "judge_flows",
    "limit_alerts",
    "microflow_aggregate",
    "microflow_json",
    "microflow_records",
    "microflows_as_flows",
    "packet_traffic",
    "parse_aggregates",
    "parse_flows",
    "parse_rejects",
    "parse_warnings",
    "read_flow_json",
    "rejected_records",
    "rolling_anomalies",
    "rolling_means",
    "rolling_sample",
    "severity",
    "split_metrics",
    "summary_records",
    "traffic_aggregate",
    "union_sketches",
    "unpivot_metrics",
    "volume_rows",
    "warning_json",
    "warning_records",
    "within_error",
]
