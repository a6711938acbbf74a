"""Row layouts, topic names and default parameters of the network-flow engine."""

from pyspark.sql import types as T

# --- fixed values: topic names, record keys and texts other systems rely on ---------------
RAW_TOPIC = "network-microflows-raw"
AGGREGATED_TOPIC = "network-microflows-aggregated"
WARNINGS_TOPIC = "network-warnings"
SUMMARY_TOPICS = {
    "in": "network-summary-bytes-inbound",
    "out": "network-summary-bytes-outbound",
    "flow": "network-summary-unique-flow-count",
}
GLOBAL_KEY = "global-key"
MISSING_KEY = "global"
PROTOCOLS = ("TCP", "UDP")
DIRECTIONS = ("INBOUND", "OUTBOUND", "LATERAL", "UNKNOWN")
TIMESTAMP_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS"

# metric column, label used in warning texts, title and unit used by the limit alerts
METRICS = (
    ("bytes_inbound", "bytes recebidos", "Alerta de bytes recebidos", "bytes recebidos"),
    ("bytes_outbound", "bytes enviados", "Alerta de bytes enviados", "bytes enviados"),
    ("unique_flow_count", "conexões únicas", "Alerta de número de conexões", "conexões"),
)

# --- default parameters -------------------------------------------------------------------
TICK = "1 second"
WINDOW = "10 seconds"
HISTORY = 30
MIN_SAMPLES = 3
RATIOS = (1.2, 1.5, 2.0)
SEVERITIES = ("regular", "media", "alta")
SAMPLE_SIZE = 60
LIMITS = (10_000_000, 1_000_000, 200)

# --- column groups ------------------------------------------------------------------------
FIVE_TUPLE = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")
AGGREGATE_SUMS = (
    "bytes_inbound",
    "bytes_outbound",
    "packets_inbound",
    "packets_outbound",
    "tcp_syn_total",
    "tcp_ack_total",
    "tcp_fin_total",
    "tcp_rst_total",
)

# --- layouts ------------------------------------------------------------------------------
_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _TIME = T.StringType(), T.TimestampType()


def layout(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FRAMES = layout(pkt_seq=_LONG, ts=_TIME, caplen=_INT, frame=T.BinaryType())

PACKETS = layout(
    pkt_seq=_LONG,
    ts=_TIME,
    src_ip=_LONG,
    dst_ip=_LONG,
    src_port=_INT,
    dst_port=_INT,
    protocol=_INT,
    payload_size=_LONG,
    tcp_flags=_INT,
)

MICROFLOWS = layout(
    tick_start=_TIME,
    src_ip=_TEXT,
    src_port=_INT,
    dst_ip=_TEXT,
    dst_port=_INT,
    protocol=_TEXT,
    dir=_TEXT,
    packets=_LONG,
    bytes=_LONG,
    min_size=_INT,
    max_size=_INT,
    mean_iat_us=_DOUBLE,
    tcp=layout(syn=_LONG, ack=_LONG, fin=_LONG, rst=_LONG),
)

FLOWS = layout(
    flow_key=_TEXT,
    src_ip=_TEXT,
    dst_ip=_TEXT,
    src_port=_LONG,
    dst_port=_LONG,
    protocol=_TEXT,
    dir=_TEXT,
    packet_count=_LONG,
    byte_count=_LONG,
    min_packet_size=_LONG,
    max_packet_size=_LONG,
    timestamp=_TIME,
    ingest_time=_TIME,
    mean_iat_us=_DOUBLE,
    tcp_syn_count=_LONG,
    tcp_fin_count=_LONG,
    tcp_rst_count=_LONG,
    tcp_ack_count=_LONG,
)

AGGREGATES = layout(
    key=_TEXT,
    window_start=_TIME,
    window_end=_TIME,
    timestamp_start=_TIME,
    timestamp_end=_TIME,
    bytes_inbound=_LONG,
    bytes_outbound=_LONG,
    packets_inbound=_LONG,
    packets_outbound=_LONG,
    unique_flow_count=_LONG,
    tcp_syn_total=_LONG,
    tcp_ack_total=_LONG,
    tcp_fin_total=_LONG,
    tcp_rst_total=_LONG,
    average_packet_size=_DOUBLE,
)

WARNINGS = layout(
    key=_TEXT,
    window_start=_TIME,
    metric=_TEXT,
    current=_LONG,
    samples=_INT,
    average=_DOUBLE,
    ratio=_DOUBLE,
    percent_above=_LONG,
    severidade=_TEXT,
    descricao=_TEXT,
)

# What a topic looks like once stored as a table.
TOPIC_ROWS = layout(
    key=_TEXT, value=_TEXT, topic=_TEXT, partition=_INT, offset=_LONG, timestamp=_TIME
)

# Header of a Kafka record that holds its event time, as microseconds since 1970 in decimal text.
EVENT_TIME_HEADER = "event-time-us"
