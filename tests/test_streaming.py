import json
import os

import pytest
from pyspark.sql import functions as F

from rillwatch.operators import (
    aggregate_records,
    closed_windows,
    microflow_records,
    microflow_aggregate,
    packet_traffic,
    rolling_anomalies,
    traffic_aggregate,
    warning_records,
)
from rillwatch.plans import catalogue, derived
from rillwatch.plans.chains import stream_flows_to_warnings
from rillwatch.schemas import AGGREGATED_TOPIC, PACKETS, RAW_TOPIC, WARNINGS_TOPIC
from rillwatch.session import cut_lineage, new_folder
from rillwatch.sources import (
    deliver_alerts,
    read_aggregates,
    read_flows,
    read_topic,
    read_warnings,
    stream_topic,
    write_topic,
)
from rillwatch.streaming import drain, read_table_stream, stream_rolling_anomalies, tap, view_job

NETWORK = (derived.LOCAL_NET, derived.LOCAL_MASK)
SHAPE = {"window": "6 hours", "tick": "1 hour"}


@pytest.fixture(scope="module")
def packets(spark, sf_dir):
    return derived.packets(derived.events_table(spark, sf_dir)).cache()


@pytest.fixture(scope="module")
def packet_files(spark, packets, tmp_path_factory):
    """The packets in time order, cut into five files that a stream reads one by one."""
    folder = str(tmp_path_factory.mktemp("packets"))
    ordered = packets.orderBy("ts").toPandas()
    size = -(-len(ordered) // 5)
    for number in range(5):
        part = spark.createDataFrame(ordered[number * size : (number + 1) * size], PACKETS)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def packet_stream(spark, folder):
    reader = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", "1")
    return reader.parquet(folder)


def test_stream_of_several_batches_equals_batch(spark, packets, packet_files):
    stream = packet_traffic(packet_stream(spark, packet_files), *NETWORK, **SHAPE, watermark="0 seconds")
    latest = packets.agg(F.max("ts")).scalar()
    expected = closed_windows(packet_traffic(packets, *NETWORK, **SHAPE), latest)
    assert sorted(drain(stream).collect()) == sorted(expected.collect())


def test_streamed_detection_equals_batch(spark, packets, packet_files):
    stream = packet_traffic(packet_stream(spark, packet_files), *NETWORK, **SHAPE, watermark="0 seconds")
    got = drain(stream_rolling_anomalies(stream, ratios=(1.05, 1.2, 1.4)))
    latest = packets.agg(F.max("ts")).scalar()
    closed = cut_lineage(closed_windows(packet_traffic(packets, *NETWORK, **SHAPE), latest))
    expected = rolling_anomalies(closed, ratios=(1.05, 1.2, 1.4))
    assert expected.count() > 20
    assert sorted(got.collect()) == sorted(expected.collect())


def test_restart_goes_on_with_the_same_state(spark, packets, tmp_path):
    folder, table, checkpoint = (str(tmp_path / name) for name in ("in", "out", "state"))
    cut = F.lit("2024-01-15").cast("timestamp")
    for part in (packets.where(F.col("ts") < cut), packets.where(F.col("ts") >= cut)):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = packet_traffic(packet_stream(spark, folder), *NETWORK, **SHAPE, watermark="0 seconds")
        got = drain(stream_rolling_anomalies(stream), table, checkpoint)
    latest = packets.agg(F.max("ts")).scalar()
    closed = cut_lineage(closed_windows(packet_traffic(packets, *NETWORK, **SHAPE), latest))
    assert sorted(got.collect()) == sorted(rolling_anomalies(closed).collect())


def test_a_late_record_after_its_window_closed_is_dropped(spark, packets, tmp_path):
    folder = str(tmp_path / "in")
    early = packets.orderBy("ts").limit(300)
    early.coalesce(1).write.parquet(folder)
    checkpoint, table = str(tmp_path / "state"), str(tmp_path / "out")

    def run():
        stream = packet_traffic(packet_stream(spark, folder), *NETWORK, **SHAPE, watermark="0 seconds")
        return drain(stream, table, checkpoint)

    before = run().count()
    early.limit(1).coalesce(1).write.mode("append").parquet(folder)
    after = run()
    assert after.count() == before
    assert after.groupBy("window_start").count().where("count > 1").count() == 0


def test_from_raw_topic_to_warnings_topic_in_one_query(spark, packets, tmp_path):
    raw, warnings = str(tmp_path / "raw"), str(tmp_path / "warnings")
    records = microflow_records(microflow_aggregate(packets, *NETWORK, tick="1 hour"))
    write_topic(records, RAW_TOPIC, fmt="parquet", path=raw)
    flows = read_flows(spark, fmt="parquet", path=raw, stream=True)
    found = stream_flows_to_warnings(flows, "6 hours")
    stream_topic(
        warning_records(found), WARNINGS_TOPIC, fmt="parquet", path=warnings, available_now=True
    ).awaitTermination()
    got = read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=warnings)
    batch = traffic_aggregate(read_flows(spark, fmt="parquet", path=raw), "6 hours")
    expected = rolling_anomalies(cut_lineage(closed_windows(cut_lineage(batch))))
    assert sorted(r.value for r in got.collect()) == sorted(
        r.value for r in warning_records(expected).collect()
    )
    assert {r.key for r in got.collect()} == {"global-key"}
    assert all(set(json.loads(r.value)) == {"severidade", "descricao"} for r in got.collect())


def test_aggregates_topic_round_trip(spark, packets, tmp_path):
    path = str(tmp_path / "aggregated")
    traffic = packet_traffic(packets, *NETWORK, **SHAPE)
    write_topic(aggregate_records(traffic), AGGREGATED_TOPIC, fmt="parquet", path=path)
    again = read_aggregates(spark, fmt="parquet", path=path)
    assert sorted(again.select(traffic.columns).collect()) == sorted(traffic.collect())


def test_a_failed_batch_comes_again_with_its_number(spark, tmp_path):
    topic, checkpoint = str(tmp_path / "topic"), str(tmp_path / "stream")
    row = spark.createDataFrame([("k", '{"severidade":"alta","descricao":"a"}')], "key STRING, value STRING")
    write_topic(row, WARNINGS_TOPIC, fmt="parquet", path=topic)
    seen = []

    def write(alerts, batch):
        seen.append((batch, alerts.count()))
        if len(seen) == 1:
            raise ValueError("not now")

    def run():
        records = read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=topic, stream=True)
        deliver_alerts(records, write, checkpoint, available_now=True).awaitTermination()

    with pytest.raises(Exception, match="not now"):
        run()
    run()
    assert seen == [(0, 1), (0, 1)]


def test_a_lasting_stream_needs_a_checkpoint(spark, tmp_path):
    topic = str(tmp_path / "topic")
    row = spark.createDataFrame([("k", "v")], "key STRING, value STRING")
    write_topic(row, WARNINGS_TOPIC, fmt="parquet", path=topic)
    records = read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=topic, stream=True)
    with pytest.raises(ValueError, match="checkpoint"):
        deliver_alerts(records, lambda alerts, batch: None)
    with pytest.raises(ValueError, match="checkpoint"):
        stream_topic(records, fmt="parquet", path=str(tmp_path / "out"))


def test_paths_with_pattern_characters_can_be_streamed(spark, packets, tmp_path):
    for name in ("plain", "odd{1}[a]*", "end-"):
        folder = str(tmp_path / name)
        packets.limit(5).write.parquet(folder)
        for path in (folder, folder + "/"):
            assert drain(read_table_stream(spark, path, PACKETS)).count() == 5


def test_a_failing_metric_leaves_the_others(spark, packets, monkeypatch):
    from rillwatch.streaming import detector

    class Fragile(detector.RollingDetector):
        def _check(self, key, starts, metric, series, known):
            if metric == "bytes_inbound":
                raise ValueError("broken")
            return super()._check(key, starts, metric, series, known)

    aggregates = packet_traffic(packets, *NETWORK, **SHAPE)
    folder = new_folder(spark, "aggregates")
    aggregates.write.parquet(folder)

    def found():
        stream = spark.readStream.schema(aggregates.schema).parquet(folder)
        rows = drain(stream_rolling_anomalies(stream, ratios=(1.05, 1.2, 1.4))).collect()
        return {m: sorted(r for r in rows if r.metric == m) for m in {r.metric for r in rows}}

    whole = found()
    monkeypatch.setattr(detector, "RollingDetector", Fragile)
    some = found()
    whole.pop("bytes_inbound")
    assert some == whole and some


def test_huge_counts_give_the_same_numbers_in_batch_and_stream(spark):
    from builders import aggregate_rows

    from rillwatch.operators import rolling_means

    rows = aggregate_rows(spark, [(n, 9 * 10**18 // (1 + (n < 5)), 10, n + 1) for n in range(8)])
    folder = new_folder(spark, "aggregates")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    got = drain(stream_rolling_anomalies(stream))
    assert sorted(got.collect()) == sorted(rolling_anomalies(rows).collect())
    means = {r.window_start: r.average for r in rolling_means(rows).collect() if r.metric == "bytes_inbound"}
    assert max(means.values()) > 4e18


def test_latest_delivers_old_times_and_what_came_while_down(spark, tmp_path):
    topic, checkpoint, seen = str(tmp_path / "topic"), str(tmp_path / "stream"), []

    def put(text):
        rows = spark.createDataFrame(
            [("k", f'{{"severidade":"alta","descricao":"{text}"}}', "2020-01-01 00:00:00")],
            "key STRING, value STRING, t STRING",
        )
        rows = rows.select("key", "value", F.col("t").cast("timestamp").alias("timestamp"))
        write_topic(rows, WARNINGS_TOPIC, fmt="parquet", path=topic)

    def run():
        view_job(
            spark,
            {"fmt": "parquet", "path": topic},
            lambda alerts, batch: seen.extend(r.text for r in alerts.collect()),
            checkpoint,
            available_now=True,
        ).awaitTermination()

    put("before")
    run()
    put("while down")
    put("and more")
    run()
    run()
    assert sorted(seen) == ["and more", "while down"]


def test_latest_skips_what_is_already_there(spark, tmp_path):
    path = str(tmp_path / "warnings")
    old = spark.createDataFrame(
        [("k", '{"severidade":"alta","descricao":"old"}', "2024-01-01 00:00:00")], "key STRING, value STRING, t STRING"
    ).select("key", "value", F.col("t").cast("timestamp").alias("timestamp"))
    write_topic(old, WARNINGS_TOPIC, fmt="parquet", path=path)
    stream = read_warnings(spark, fmt="parquet", path=path, stream=True)
    write_topic(
        old.withColumn("value", F.lit('{"severidade":"media","descricao":"new"}')).drop("timestamp"),
        WARNINGS_TOPIC,
        fmt="parquet",
        path=path,
    )
    assert [tuple(r) for r in drain(stream).collect()] == [("media", "new")]
    assert read_warnings(spark, fmt="parquet", path=path).count() == 2
    with pytest.raises(ValueError):
        read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=path, starting="latest")


def test_unreadable_warnings_do_not_stop_delivery(spark, tmp_path):
    topic, out = str(tmp_path / "topic"), str(tmp_path / "out")
    values = ['{"severidade":"alta","descricao":"a"}', "{bad", None, '{"severidade":"x","descricao":"b"}']
    write_topic(
        spark.createDataFrame([("k", v) for v in values], "key STRING, value STRING"),
        WARNINGS_TOPIC,
        fmt="parquet",
        path=topic,
    )
    records = read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=topic, stream=True)
    deliver_alerts(records, lambda alerts, batch: alerts.write.mode("append").parquet(out), available_now=True).awaitTermination()
    got = spark.read.parquet(out).orderBy("text").collect()
    assert [(r.level, r.text) for r in got] == [("ERROR", "a"), ("INFO", "b")]


def test_taps_count_rows_of_a_stream(spark, packet_files):
    stream = tap(packet_stream(spark, packet_files), "received", bytes=F.sum("payload_size"))
    query = (
        stream.writeStream.format("noop")
        .option("checkpointLocation", new_folder(spark, "taps"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counted = sum(p.observedMetrics["received"]["rows"] for p in query.recentProgress if p.observedMetrics)
    assert counted == spark.read.schema(PACKETS).parquet(packet_files).count()


def test_kafka_rows_have_topic_key_and_value(spark, packets):
    from rillwatch.sources.sinks import _kafka_rows

    records = microflow_records(microflow_aggregate(packets, *NETWORK, tick="1 hour"))
    rows = _kafka_rows(records, RAW_TOPIC)
    assert rows.dtypes == [("key", "string"), ("value", "string"), ("topic", "string")]
    assert rows.where(F.col("key").isNotNull()).count() == 0
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic(spark, RAW_TOPIC, **{"kafka.bootstrap.servers": "unused:9092"})


def test_state_folders_lie_in_the_shared_folder(spark):
    assert new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir"))


def test_restarted_stream_reads_several_files_a_batch(spark, sf_dir, monkeypatch):
    seen, read = [], catalogue.read_table_stream

    def counted(session, folder, layout, **options):
        names = session.read.parquet(folder).select(F.input_file_name().alias("f")).distinct().count()
        seen.append((names, int(options["maxFilesPerTrigger"])))
        return read(session, folder, layout, **options)

    monkeypatch.setattr(catalogue, "read_table_stream", counted)
    assert catalogue.q_stream_restart(spark, sf_dir).count()
    files = catalogue.STREAM_PARTITIONS
    assert seen == [(2 * files, files), (4 * files, files)]
