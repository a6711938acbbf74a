"""The registered queries: every operator over the whole of its table."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    flag_count,
    flags_text,
    flow_key,
    ip_to_text,
    one_decimal,
    protocol_name,
    signed_zero,
    text_to_ip,
)
from ..functions.packets import ACK, FIN, RST, SYN, TCP
from ..operators import (
    aggregate_json,
    aggregate_records,
    alert_messages,
    branch_by_prefix,
    classify_direction,
    closed_windows,
    decode_frames,
    drop_late,
    estimated_flows,
    expanding_stats,
    flow_json,
    flow_report,
    flow_rows,
    flow_sketches,
    limit_alerts,
    microflow_aggregate,
    microflow_json,
    microflow_records,
    microflows_as_flows,
    packet_traffic,
    parse_aggregates,
    parse_flows,
    parse_rejects,
    parse_warnings,
    read_flow_json,
    rolling_anomalies,
    rolling_means,
    rolling_sample,
    split_metrics,
    summary_records,
    traffic_aggregate,
    union_sketches,
    unpivot_metrics,
    volume_rows,
    warning_json,
    warning_records,
    within_error,
)
from ..schemas import (
    AGGREGATED_TOPIC,
    PACKETS,
    RAW_TOPIC,
    FLOWS,
    SUMMARY_TOPICS,
    TOPIC_ROWS,
    WARNINGS_TOPIC,
)
from ..session import configure, cut_lineage, new_folder
from ..sources import (
    deliver_alerts,
    read_aggregates,
    read_flows,
    read_frames,
    read_packets,
    read_topic,
    stream_topic,
    write_topic,
)
from ..streaming import (
    MetricsRecorder,
    aggregate_job,
    alert_job,
    capture_job,
    detector_state,
    drain,
    last_windows,
    limit_job,
    metric_totals,
    on_time_job,
    publish_batch,
    quarantine_job,
    read_results,
    read_table_stream,
    split_job,
    stream_rolling_anomalies,
    view_job,
    watch_job,
)
from ..streaming.delivery import outcome_schema
from . import derived
from .derived import LOCAL_MASK, LOCAL_NET, TICK, WINDOW, events_table
from .chains import frames_to_alerts, packets_to_warnings

NETWORK = (LOCAL_NET, LOCAL_MASK)
# state partitions of the streams of these queries
STREAM_PARTITIONS = 8
# fixed limits of the limit_alerts query, in the range of the derived traffic
QUERY_LIMITS = {"bytes_in": 1500, "bytes_out": 3000, "unique_flows": 15}
# what the queries read of the alerts that a stream has written
_ALERTS = "level STRING, title STRING, text STRING"


def ntz(df: DataFrame) -> DataFrame:
    """Times without a zone, as the source table has them."""
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in times})


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.packets(events_table(spark, sf_dir))


def _microflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return microflow_aggregate(_packets(spark, sf_dir), *NETWORK, tick=TICK)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return microflows_as_flows(_microflows(spark, sf_dir))


def _aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_traffic(_packets(spark, sf_dir), *NETWORK, window=WINDOW, tick=TICK)


def _stored_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(_aggregates(spark, sf_dir))


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_to_warnings(_packets(spark, sf_dir), *NETWORK, tick=TICK, window=WINDOW)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.raw_records(events_table(spark, sf_dir))


def _drained(stream: DataFrame, **folders: str) -> DataFrame:
    return drain(stream, partitions=STREAM_PARTITIONS, **folders)


def _packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    events = read_table_stream(spark, f"{sf_dir}/events.parquet", derived.EVENTS)
    return derived.packets(derived.with_event_time(events))


# --- decoding and scalar functions ----------------------------------------------------------


def q_decode_frames(spark, sf_dir):
    return ntz(decode_frames(derived.frames(events_table(spark, sf_dir))))


def q_decode_filters(spark, sf_dir):
    packets = decode_frames(derived.frames(events_table(spark, sf_dir)))
    return packets.groupBy(protocol_name(F.col("protocol")).alias("protocol")).agg(
        F.count("*").alias("kept"),
        F.count_if(F.col("payload_size") == 0).alias("empty_payload"),
        F.sum("payload_size").alias("payload"),
    )


def q_classify_direction(spark, sf_dir):
    packets = _packets(spark, sf_dir)
    known = classify_direction(packets, *NETWORK).withColumnRenamed("dir", "known_net")
    return classify_direction(known, 0, 0).select("pkt_seq", "known_net", F.col("dir").alias("no_net"))


def q_protocol_name(spark, sf_dir):
    number = (F.col("event_id") % 20).cast("int")
    return events_table(spark, sf_dir).select(
        "event_id", number.alias("number"), protocol_name(number).alias("protocol")
    )


def q_ip_text(spark, sf_dir):
    texts = _packets(spark, sf_dir).select(
        "pkt_seq", ip_to_text(F.col("src_ip")).alias("src"), ip_to_text(F.col("dst_ip")).alias("dst")
    )
    return texts.withColumn("src_ip", text_to_ip(F.col("src"))).withColumn(
        "dst_ip", text_to_ip(F.col("dst"))
    )


def q_tcp_flag_counts(spark, sf_dir):
    protocol, flags = F.col("protocol"), F.col("tcp_flags")
    return _packets(spark, sf_dir).groupBy("src_port").agg(
        *[
            flag_count(protocol, flags, bit).alias(name)
            for name, bit in (("syn", SYN), ("ack", ACK), ("fin", FIN), ("rst", RST))
        ]
    )


def q_flags_text(spark, sf_dir):
    return events_table(spark, sf_dir).select(
        "event_id",
        flags_text(F.lit(TCP), (F.col("event_id") % 64).cast("int")).alias("flags"),
    )


# --- microflows -----------------------------------------------------------------------------


def _flat(microflows: DataFrame) -> DataFrame:
    counts = [F.col(f"tcp.{flag}").alias(f"tcp_{flag}") for flag in ("syn", "ack", "fin", "rst")]
    return ntz(microflows.select("*", *counts).drop("tcp"))


def q_microflow_aggregate(spark, sf_dir):
    return _flat(_microflows(spark, sf_dir))


def q_mean_iat(spark, sf_dir):
    return (
        _microflows(spark, sf_dir)
        .where(F.col("packets") > 1)
        .groupBy("protocol", "dir")
        .agg(
            F.count("*").alias("flows"),
            F.min("mean_iat_us").alias("shortest"),
            F.max("mean_iat_us").alias("longest"),
        )
    )


def q_microflow_json(spark, sf_dir):
    return ntz(_microflows(spark, sf_dir).select("tick_start", microflow_json().alias("value")))


def q_flow_report(spark, sf_dir):
    return ntz(flow_report(_microflows(spark, sf_dir)))


# --- parsing --------------------------------------------------------------------------------


def q_parse_flows(spark, sf_dir):
    return ntz(parse_flows(_raw(spark, sf_dir)).drop("ingest_time"))


def q_parse_rejects(spark, sf_dir):
    return ntz(parse_rejects(_raw(spark, sf_dir)).drop("key"))


def q_flow_key(spark, sf_dir):
    return (
        _microflows(spark, sf_dir)
        .groupBy(flow_key().alias("flow_key"))
        .agg(F.count("*").alias("ticks"), F.sum("packets").alias("packets"))
    )


def q_flow_record_json(spark, sf_dir):
    flows = _flows(spark, sf_dir).withColumn("flow_key", flow_key())
    # one decimal, so that the number prints the same everywhere
    rounded = flows.withColumns({"mean": F.col("mean_iat_us"), "mean_iat_us": one_decimal(F.col("mean_iat_us"))})
    return rounded.select(signed_zero(flow_json(), "mean_iat_us", F.col("mean")).alias("value"))


def q_flow_record_roundtrip(spark, sf_dir):
    flows = parse_flows(_raw(spark, sf_dir))
    return ntz(read_flow_json(flows.select(flow_json().alias("value"))))


# --- traffic aggregates ---------------------------------------------------------------------


def q_traffic_aggregate(spark, sf_dir):
    return ntz(traffic_aggregate(_flows(spark, sf_dir), WINDOW))


def q_packet_traffic(spark, sf_dir):
    return ntz(_aggregates(spark, sf_dir))


def q_raw_traffic(spark, sf_dir):
    return ntz(traffic_aggregate(parse_flows(_raw(spark, sf_dir)), WINDOW))


def q_traffic_by_direction(spark, sf_dir):
    return ntz(traffic_aggregate(_flows(spark, sf_dir), WINDOW, group_cols=["dir"]))


def q_traffic_by_host_and_protocol(spark, sf_dir):
    return ntz(traffic_aggregate(_flows(spark, sf_dir), WINDOW, group_cols=["src_ip", "protocol"]))


def _unique(spark, sf_dir, key_mode):
    aggregates = traffic_aggregate(_flows(spark, sf_dir), WINDOW, key_mode=key_mode)
    return ntz(aggregates.select("window_start", "unique_flow_count"))


def q_unique_flows(spark, sf_dir):
    return _unique(spark, sf_dir, "tuple")


def q_unique_flows_sketch(spark, sf_dir):
    """Whether the sketches of all windows, and their unions over days, are as exact as they claim."""
    flows = cut_lineage(_flows(spark, sf_dir))
    hours = cut_lineage(flow_sketches(flows, WINDOW))
    checked = []
    for name, length, sketches in (("hour", WINDOW, hours), ("day", "1 day", union_sketches(hours, "1 day"))):
        exact = traffic_aggregate(flows, length).select("key", "window_start", "unique_flow_count")
        ok = within_error(estimated_flows(), F.col("unique_flow_count"))
        both = sketches.join(exact, ["key", "window_start"], "full")
        checked.append(both.select(F.lit(name).alias("length"), "window_start", F.coalesce(ok, F.lit(False)).alias("ok")))
    return ntz(checked[0].unionByName(checked[1]))


def q_unique_flows_concat(spark, sf_dir):
    return _unique(spark, sf_dir, "concat")


def q_avg_packet_size(spark, sf_dir):
    by_way = traffic_aggregate(_flows(spark, sf_dir), WINDOW, group_cols=["dir"])
    return ntz(by_way.select("key", "window_start", "average_packet_size"))


def q_aggregate_json(spark, sf_dir):
    # the digits of the mean print differently per engine: it is compared as a number beside the text
    text = aggregate_json()
    mean = '("averagePacketSize":)[^,]*'
    return _aggregates(spark, sf_dir).select(
        "key",
        F.regexp_replace(text, mean, "$1null").alias("value"),
        F.get_json_object(text, "$.averagePacketSize").cast("double").alias("average_packet_size"),
    )


def q_aggregate_json_roundtrip(spark, sf_dir):
    return ntz(parse_aggregates(aggregate_records(_aggregates(spark, sf_dir))))


def q_closed_windows(spark, sf_dir):
    return ntz(closed_windows(_stored_aggregates(spark, sf_dir)))


def q_drop_late(spark, sf_dir):
    records = derived.arrivals(events_table(spark, sf_dir))
    kept = drop_late(records, WINDOW, ("arrival", "pkt_seq"))
    return ntz(kept.select("pkt_seq", "timestamp"))


def q_drop_late_by_partition(spark, sf_dir):
    records = derived.arrivals(events_table(spark, sf_dir))
    kept = drop_late(records, WINDOW, ("arrival", "pkt_seq"), "source_partition", chunk_rows=1000)
    return ntz(kept.select("source_partition", "pkt_seq", "timestamp"))


# --- detection ------------------------------------------------------------------------------


def q_unpivot_metrics(spark, sf_dir):
    return ntz(unpivot_metrics(_aggregates(spark, sf_dir)))


def q_rolling_mean_30(spark, sf_dir):
    return ntz(rolling_means(_stored_aggregates(spark, sf_dir)).drop("label"))


def q_rolling_anomalies(spark, sf_dir):
    return ntz(_warnings(spark, sf_dir))


def q_rolling_anomalies_by_host(spark, sf_dir):
    packets = _packets(spark, sf_dir)
    warnings = packets_to_warnings(
        packets, *NETWORK, tick=TICK, window=WINDOW, group_cols=["src_ip"], chunk_windows=64
    )
    return ntz(warnings)


def q_null_key_anomalies(spark, sf_dir):
    unkeyed = _stored_aggregates(spark, sf_dir).withColumn("key", F.lit(None).cast("string"))
    return ntz(rolling_anomalies(unkeyed, chunk_windows=64).select("key", "window_start", "metric"))


def q_anomaly_severity_counts(spark, sf_dir):
    return (
        _warnings(spark, sf_dir)
        .groupBy("metric", "severidade")
        .agg(F.count("*").alias("warnings"), F.max("percent_above").alias("most_above"))
    )


def q_warning_text(spark, sf_dir):
    return ntz(_warnings(spark, sf_dir).select("window_start", "metric", "descricao"))


def q_warning_json(spark, sf_dir):
    return ntz(_warnings(spark, sf_dir).select("window_start", warning_json().alias("value")))


def q_limit_alerts(spark, sf_dir):
    return ntz(limit_alerts(_aggregates(spark, sf_dir), **QUERY_LIMITS))


def q_rolling_sample_60(spark, sf_dir):
    return ntz(rolling_sample(_stored_aggregates(spark, sf_dir), chunk_windows=100))


def q_expanding_stats(spark, sf_dir):
    return ntz(expanding_stats(_stored_aggregates(spark, sf_dir), chunk_windows=100))


# --- routing --------------------------------------------------------------------------------


def q_split_metrics(spark, sf_dir):
    return ntz(split_metrics(_aggregates(spark, sf_dir)))


def q_branch_by_prefix(spark, sf_dir):
    aggregates = _aggregates(spark, sf_dir)
    rows = volume_rows(aggregates).unionByName(flow_rows(aggregates))
    return ntz(branch_by_prefix(rows, {"in": "branch-in", "out": "branch-out"}))


def q_alert_messages(spark, sf_dir):
    alerts = alert_messages(_warnings(spark, sf_dir))
    return ntz(alerts.select("window_start", "metric", "level", "title", "text"))


def q_parse_warnings(spark, sf_dir):
    records = derived.warning_topic(events_table(spark, sf_dir))
    return alert_messages(parse_warnings(records)).drop("text")


def q_frames_to_alerts(spark, sf_dir):
    frames = derived.frames(events_table(spark, sf_dir))
    alerts = frames_to_alerts(frames, *NETWORK, tick=TICK, window=WINDOW)
    return ntz(alerts.select("window_start", "metric", "current", "level", "title", "text"))


# --- topics and streams ---------------------------------------------------------------------


def q_topic_roundtrip(spark, sf_dir):
    """Microflows through the raw topic (file form) and back, then aggregated."""
    folder = new_folder(spark, "topic")
    write_topic(microflow_records(_microflows(spark, sf_dir)), RAW_TOPIC, fmt="parquet", path=folder)
    raw = read_topic(spark, RAW_TOPIC, fmt="parquet", path=folder)
    return ntz(traffic_aggregate(parse_flows(raw), WINDOW))


def q_stream_microflow_aggregate(spark, sf_dir):
    packets = _packet_stream(spark, sf_dir)
    return _flat(_drained(microflow_aggregate(packets, *NETWORK, tick=TICK, watermark="0 seconds")))


def q_stream_traffic_aggregate(spark, sf_dir):
    packets = _packet_stream(spark, sf_dir)
    traffic = packet_traffic(packets, *NETWORK, window=WINDOW, tick=TICK, watermark="0 seconds")
    return ntz(_drained(traffic))


def q_stream_raw_traffic(spark, sf_dir):
    configure(spark)
    events = read_table_stream(spark, f"{sf_dir}/events.parquet", derived.EVENTS)
    flows = parse_flows(derived.raw_records(derived.with_event_time(events)))
    return ntz(_drained(traffic_aggregate(flows, WINDOW, watermark="0 seconds")))


def q_stream_rolling_anomalies(spark, sf_dir):
    packets = _packet_stream(spark, sf_dir)
    traffic = packet_traffic(packets, *NETWORK, window=WINDOW, tick=TICK, watermark="0 seconds")
    return ntz(_drained(stream_rolling_anomalies(traffic)))


def q_routed_sinks(spark, sf_dir):
    """The three summary topics written by one stream, read back from their own folders."""
    packets = _packet_stream(spark, sf_dir)
    traffic = packet_traffic(packets, *NETWORK, window=WINDOW, tick=TICK, watermark="0 seconds")
    folder = new_folder(spark, "summaries")
    stream_topic(
        summary_records(traffic),
        fmt="parquet",
        path=folder,
        available_now=True,
        partitions=STREAM_PARTITIONS,
    ).awaitTermination()
    topics = [read_topic(spark, name, fmt="parquet", path=folder) for name in SUMMARY_TOPICS.values()]
    rows = topics[0].unionByName(topics[1]).unionByName(topics[2])
    return ntz(rows.select("topic", "key", F.col("value").cast("bigint").alias("value"), "timestamp"))


def _stored_in(path: str) -> Callable[[DataFrame, int], object]:
    """A writer of micro-batches to a result table, which can be read although there was none to write."""
    return lambda batch, number: publish_batch(batch, path, number)


def q_alert_delivery(spark, sf_dir):
    """Warnings topic written, then delivered as alert rows by a stream."""
    configure(spark)
    topic, delivered = new_folder(spark, "warnings"), new_folder(spark, "alerts")
    write_topic(warning_records(_warnings(spark, sf_dir)), WARNINGS_TOPIC, fmt="parquet", path=topic)
    records = read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=topic, stream=True)
    deliver_alerts(records, _stored_in(delivered), available_now=True).awaitTermination()
    return read_results(spark, delivered, _ALERTS).drop("batch")


def q_stream_latest_warnings(spark, sf_dir):
    """Half of the warnings written before the alert job first starts, a part while it is down, the rest
    before it runs again: the job delivers all but the first half, once."""
    warnings = cut_lineage(_warnings(spark, sf_dir))
    third = F.day("window_start") % 3
    topic, delivered, checkpoint = (new_folder(spark, n) for n in ("warnings", "alerts", "stream"))
    source = {"fmt": "parquet", "path": topic}
    for part in (0, 1, 2):
        records = warning_records(warnings.where(third == part))
        write_topic(records, WARNINGS_TOPIC, fmt="parquet", path=topic)
        view_job(spark, source, _stored_in(delivered), checkpoint, available_now=True).awaitTermination()
    return read_results(spark, delivered, _ALERTS).drop("batch")


def _extreme(spark, sf_dir):
    """Raw records of which every fourth has a byte count far beyond BIGINT, as text."""
    value = F.when(
        F.col("offset") % 4 == 0,
        F.regexp_replace("value", '"bytes":[0-9]+', '"bytes":1000000000000000000000000000000'),
    ).otherwise(F.col("value"))
    return _raw(spark, sf_dir).withColumn("value", value)


def q_raw_traffic_extreme_numbers(spark, sf_dir):
    return ntz(traffic_aggregate(parse_flows(_extreme(spark, sf_dir)), WINDOW))


def q_rolling_sample_extreme_numbers(spark, sf_dir):
    traffic = traffic_aggregate(parse_flows(_extreme(spark, sf_dir)), WINDOW)
    return ntz(rolling_sample(cut_lineage(traffic), chunk_windows=100))


def _huge_counts(spark, sf_dir):
    """Aggregates of which every fourth day has byte counts whose sum is beyond BIGINT."""
    huge = F.day("window_start") % 4 == 0
    counts = {n: F.when(huge, F.lit(5 * 10**18)).otherwise(F.col(n)) for n in ("bytes_inbound", "bytes_outbound")}
    return _aggregates(spark, sf_dir).withColumns(counts)


def q_aggregates_extreme_numbers(spark, sf_dir):
    return ntz(parse_aggregates(aggregate_records(_huge_counts(spark, sf_dir))))


def q_watch_extreme_numbers(spark, sf_dir):
    """The watching application over such aggregates, and how many warnings of each metric it finds."""
    topic, warnings = new_folder(spark, "topic"), new_folder(spark, "warnings")
    records = aggregate_records(_huge_counts(spark, sf_dir))
    write_topic(records, AGGREGATED_TOPIC, fmt="parquet", path=topic)
    sink = {"fmt": "parquet", "path": warnings, "available_now": True, "partitions": STREAM_PARTITIONS}
    watch_job(spark, {"fmt": "parquet", "path": topic}, sink).awaitTermination()
    found = alert_messages(parse_warnings(read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=warnings)))
    return found.groupBy("level", "title").agg(F.count("*").alias("alerts"))


def q_stream_quarantine(spark, sf_dir):
    """The raw topic parsed once by a stream, into flows and bad records."""
    topic, good, bad, checkpoint = (new_folder(spark, n) for n in ("topic", "flows", "rejects", "stream"))
    write_topic(_raw(spark, sf_dir), RAW_TOPIC, fmt="parquet", path=topic)
    source = {"fmt": "parquet", "path": topic}
    quarantine_job(spark, source, good, bad, checkpoint, available_now=True).awaitTermination()
    flows, rejects = read_results(spark, good, FLOWS), read_results(spark, bad, TOPIC_ROWS)
    accepted = flows.select(F.lit("accepted").alias("half"), F.col("flow_key").alias("text"), "timestamp")
    return ntz(accepted.unionByName(rejects.select(F.lit("rejected").alias("half"), F.col("value").alias("text"), "timestamp")))


def q_stream_drop_late(spark, sf_dir):
    """Late records of the raw topic by its partitions, as a stream that is stopped after each quarter."""
    topic, kept, checkpoint = (new_folder(spark, n) for n in ("topic", "kept", "stream"))
    records = cut_lineage(derived.arrivals(events_table(spark, sf_dir)))
    last = records.agg(F.max("arrival")).first()[0] or 0
    quarter = F.least(F.lit(3), F.floor(F.col("arrival") * 4 / (last + 1)))
    for part in range(4):
        some = records.where(quarter == part).select(
            F.col("pkt_seq").cast("string").alias("value"),
            F.col("source_partition").alias("partition"),
            (F.col("arrival") * 1_000_000 + F.col("pkt_seq")).alias("offset"),
            "timestamp",
        )
        write_topic(some, RAW_TOPIC, fmt="parquet", path=topic)
        on_time_job(
            spark, {"fmt": "parquet", "path": topic}, kept, checkpoint, WINDOW, available_now=True
        ).awaitTermination()
    rows = read_results(spark, kept, TOPIC_ROWS)
    return ntz(
        rows.select(F.col("partition").alias("source_partition"), F.col("value").cast("bigint").alias("pkt_seq"), "timestamp")
    )


def _halves(spark, sf_dir):
    """Stored aggregates of the first half of the month and of the rest."""
    aggregates = _stored_aggregates(spark, sf_dir)
    return aggregates.where(F.day("window_start") < 16), aggregates.where(F.day("window_start") >= 16)


def q_stream_detection_from_history(spark, sf_dir):
    """Detection of the first half in batch, handed over to a stream for the second."""
    configure(spark)
    earlier, later = _halves(spark, sf_dir)
    folder = new_folder(spark, "aggregates")
    later.write.parquet(folder)
    stream = read_table_stream(spark, folder, later.schema)
    found = _drained(stream_rolling_anomalies(stream, earlier=earlier))
    return ntz(rolling_anomalies(earlier, chunk_windows=64).unionByName(found))


def q_detector_state(spark, sf_dir):
    """The values that a detecting stream holds at its end, read from its checkpoint."""
    configure(spark)
    aggregates = _stored_aggregates(spark, sf_dir)
    folder, checkpoint = new_folder(spark, "aggregates"), new_folder(spark, "stream")
    aggregates.write.parquet(folder)
    stream = read_table_stream(spark, folder, aggregates.schema)
    _drained(stream_rolling_anomalies(stream), checkpoint=checkpoint)
    held = detector_state(spark, checkpoint)
    return held.select("key", "metric", F.posexplode("values").alias("place", "value"))


def q_alert_delivery_retry(spark, sf_dir):
    """Alerts to a receiver that is down at first and never takes one of the texts."""
    topic, outcomes, checkpoint = (new_folder(spark, n) for n in ("warnings", "outcomes", "stream"))
    warnings = cut_lineage(_warnings(spark, sf_dir))
    write_topic(warning_records(warnings), WARNINGS_TOPIC, fmt="parquet", path=topic)
    refused = warnings.agg(F.min("descricao")).first()[0]
    calls = []

    def connect() -> None:
        calls.append(1)
        if len(calls) == 1:
            raise ConnectionError("the receiver is down")

    def send(alert: dict) -> None:
        if alert["text"] == refused:
            raise ValueError("refused")

    source = {"fmt": "parquet", "path": topic, "starting": "earliest"}
    schema = alert_job(
        spark, source, send, outcomes, checkpoint, connect=connect, available_now=True, pause=0.1
    )
    found = read_results(spark, outcomes, outcome_schema(schema))
    return found.select("level", "title", "text", F.col("error").isNotNull().alias("dead"))


def q_stream_latest_summaries(spark, sf_dir):
    """The splitting application from new records on: half of the aggregates written before it first starts,
    the rest while it is down."""
    topic, summaries, checkpoint = (new_folder(spark, n) for n in ("topic", "summaries", "stream"))
    sink = {
        "fmt": "parquet",
        "path": summaries,
        "checkpoint": checkpoint,
        "available_now": True,
        "partitions": STREAM_PARTITIONS,
    }
    for half in _halves(spark, sf_dir):
        write_topic(aggregate_records(half), AGGREGATED_TOPIC, fmt="parquet", path=topic)
        split_job(spark, {"fmt": "parquet", "path": topic}, sink).awaitTermination()
    rows = spark.read.schema(TOPIC_ROWS).parquet(summaries)
    return ntz(rows.select("topic", "key", F.col("value").cast("bigint").alias("value"), "timestamp"))


def q_stream_stage_counts(spark, sf_dir):
    """Rows parsed and emitted by the aggregating application, counted by Spark batch by batch."""
    topic, out, metrics = (new_folder(spark, n) for n in ("topic", "aggregates", "metrics"))
    write_topic(_raw(spark, sf_dir), RAW_TOPIC, fmt="parquet", path=topic)
    sink = {"fmt": "parquet", "path": out, "available_now": True, "partitions": STREAM_PARTITIONS}
    with MetricsRecorder(spark, metrics) as recorder:
        query = aggregate_job(spark, {"fmt": "parquet", "path": topic}, sink, window=WINDOW)
        query.awaitTermination()
        recorder.wait(query)
    totals = metric_totals(spark, metrics)
    return totals.select("point", "metric", F.col("value").cast("bigint").alias("value"))


def q_drop_late_topic(spark, sf_dir):
    """Late records of the raw topic, read back in the order of its offsets."""
    folder = new_folder(spark, "topic")
    records = derived.arrivals(events_table(spark, sf_dir)).select(
        F.col("pkt_seq").cast("string").alias("value"),
        (F.col("arrival") * 1_000_000 + F.col("pkt_seq")).alias("offset"),
        "timestamp",
    )
    write_topic(records, RAW_TOPIC, fmt="parquet", path=folder)
    kept = drop_late(read_topic(spark, RAW_TOPIC, fmt="parquet", path=folder), WINDOW, chunk_rows=10**9)
    return ntz(kept.select(F.col("value").cast("bigint").alias("pkt_seq"), "timestamp"))


def q_aggregates_topic(spark, sf_dir):
    """Aggregates through their topic and its reader."""
    folder = new_folder(spark, "topic")
    records = aggregate_records(_aggregates(spark, sf_dir))
    write_topic(records, AGGREGATED_TOPIC, fmt="parquet", path=folder)
    return ntz(read_aggregates(spark, fmt="parquet", path=folder))


def q_stored_frames(spark, sf_dir):
    """Frames and packets through their tables and readers: frames decoded, stored, aggregated."""
    frames, packets = new_folder(spark, "frames"), new_folder(spark, "packets")
    derived.frames(events_table(spark, sf_dir)).write.parquet(frames)
    decode_frames(read_frames(spark, frames)).write.parquet(packets)
    return ntz(read_packets(spark, packets))


def q_ingest_time(spark, sf_dir):
    """Flows that were given the time of reading, and those read in another order than time allows."""
    folder = new_folder(spark, "topic")
    started = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    write_topic(_raw(spark, sf_dir), RAW_TOPIC, fmt="parquet", path=folder)
    flows = read_flows(spark, fmt="parquet", path=folder)
    return flows.agg(
        F.count("*").alias("flows"),
        F.count_if(F.col("ingest_time").isNull() | (F.col("ingest_time") < started)).alias("wrong"),
    )


def q_stream_restart(spark, sf_dir):
    """Windows and detection over four parts in time order, one to a micro-batch, every fiftieth row in a
    part too late; stopped half-way and started again. A part is a fixed number of files."""
    folder, table, checkpoint = (new_folder(spark, n) for n in ("files", "table", "stream"))
    day = F.day("ts")
    week = F.when(day < 8, 0).when(day < 15, 1).when(day < 22, 2).otherwise(3)
    late = F.when(F.col("pkt_seq") % 50 == 0, 1).otherwise(0)
    dealt = cut_lineage(_packets(spark, sf_dir).withColumn("part", F.least(F.lit(3), week + late)))
    held = dict(dealt.groupBy("part").count().collect())  # one row a part
    # rows are dealt out task by task: with so many, no file stays empty and thereby unwritten
    enough = STREAM_PARTITIONS * dealt.rdd.getNumPartitions()
    files = STREAM_PARTITIONS if min(held.get(part, 0) for part in range(4)) >= enough else 1
    for part in range(4):
        some = dealt.where(F.col("part") == part).drop("part")
        some.repartition(files).write.mode("append").parquet(folder)
        if part % 2 == 0:
            continue
        stream = read_table_stream(spark, folder, PACKETS, maxFilesPerTrigger=str(files))
        traffic = packet_traffic(stream, *NETWORK, window=WINDOW, tick=TICK, watermark="0 seconds")
        out = _drained(stream_rolling_anomalies(traffic), path=table, checkpoint=checkpoint)
    return ntz(out)


def q_stream_rolling_anomalies_by_host(spark, sf_dir):
    packets = _packet_stream(spark, sf_dir)
    traffic = packet_traffic(
        packets, *NETWORK, window=WINDOW, tick=TICK, watermark="0 seconds", group_cols=["src_ip"]
    )
    return ntz(_drained(stream_rolling_anomalies(traffic)))


def q_applications(spark, sf_dir):
    """The six applications one after the other, counted at each topic or writer."""
    names = ("frames", "raw", "aggregates", "warnings", "summaries", "limits", "alerts")
    at = {name: new_folder(spark, name) for name in names}

    def topic(name: str) -> dict:
        return {"fmt": "parquet", "path": at[name]}

    def sink(name: str) -> dict:
        return {**topic(name), "available_now": True, "partitions": STREAM_PARTITIONS}

    derived.frames(events_table(spark, sf_dir)).write.parquet(at["frames"])
    capture_job(
        read_frames(spark, at["frames"], stream=True), *NETWORK, sink("raw"), tick=TICK
    ).awaitTermination()
    aggregate_job(spark, topic("raw"), sink("aggregates"), window=WINDOW).awaitTermination()
    watch_job(spark, topic("aggregates"), sink("warnings")).awaitTermination()
    early = {"starting": "earliest"}
    split_job(spark, {**topic("aggregates"), **early}, sink("summaries")).awaitTermination()
    limit_job(
        spark, {**topic("aggregates"), **early}, _stored_in(at["limits"]), available_now=True,
        **QUERY_LIMITS,
    ).awaitTermination()
    view_job(
        spark, {**topic("warnings"), **early}, _stored_in(at["alerts"]), available_now=True
    ).awaitTermination()
    # a stage that has written nothing counts too
    written = {name: spark.read.schema(TOPIC_ROWS).parquet(at[name]) for name in names[1:5]}
    written |= {name: read_results(spark, at[name], _ALERTS) for name in names[5:]}
    counted = [
        rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "rows")
        for name, rows in written.items()
    ]
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return result


def q_stage_counts(spark, sf_dir):
    """Rows received, parsed and emitted, counted while the records pass."""
    received, parsed, emitted = (Observation(name) for name in ("received", "parsed", "emitted"))

    def rows() -> Column:
        return F.count(F.lit(1)).alias("rows")

    flows = parse_flows(_raw(spark, sf_dir).observe(received, rows()))
    traffic = traffic_aggregate(flows.observe(parsed, rows(), F.sum("byte_count").alias("bytes")), WINDOW)
    records = aggregate_records(traffic).observe(emitted, rows())
    folder = new_folder(spark, "metrics")
    write_topic(records, AGGREGATED_TOPIC, fmt="parquet", path=folder)
    counts = [
        ("received_rows", received.get["rows"]),
        ("parsed_rows", parsed.get["rows"]),
        ("parsed_bytes", parsed.get["bytes"]),
        ("emitted_rows", emitted.get["rows"]),
    ]
    return spark.createDataFrame(counts, "metric STRING, value BIGINT")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: function for name, function in list(globals().items()) if name.startswith("q_")
}
