"""Results of micro-batches: once each, with their bad records, late records, retries and metrics."""

import json
import os

import pytest
from builders import aggregate_rows
from pyspark.sql import functions as F

from rillwatch.operators import (
    accepted_flows,
    aggregate_records,
    drop_late,
    flow_sketches,
    judge_flows,
    parse_aggregates,
    parse_flows,
    parse_rejects,
    rejected_records,
    rolling_anomalies,
    traffic_aggregate,
    union_sketches,
    estimated_flows,
)
from rillwatch.operators.sketch import standard_error
from rillwatch.plans import derived
from rillwatch.schemas import AGGREGATED_TOPIC, FLOWS, RAW_TOPIC, TOPIC_ROWS, WARNINGS_TOPIC
from rillwatch.session import cut_lineage, publish, subfolders
from rillwatch.sources import in_file_order, read_topic, write_topic
from rillwatch.streaming import (
    MetricsRecorder,
    ReceiverDown,
    alert_job,
    dead_letters,
    deliver_once,
    delivered,
    detector_state,
    drain,
    metric_totals,
    on_time_job,
    quarantine_job,
    read_results,
    split_job,
    stored_batches,
    stream_rolling_anomalies,
    supervise,
    tap,
    watch_job,
)

# ---------------------------------------------------------------- numbers and halves


def test_counts_whose_sum_is_too_large_do_not_stop_a_job(spark, tmp_path):
    fields = {"timestamp_start": None, "bytes_inbound": 5 * 10**18, "bytes_outbound": 5 * 10**18}
    fields |= {"packets_inbound": 9 * 10**18, "packets_outbound": 9 * 10**18}
    row = spark.createDataFrame([("k", json.dumps(fields))], "key STRING, value STRING")
    read = parse_aggregates(row).first()
    assert read.average_packet_size == 10**19 / (18 * 10**18)
    topic, out = str(tmp_path / "topic"), str(tmp_path / "out")
    write_topic(row, AGGREGATED_TOPIC, fmt="parquet", path=topic)
    source, sink = {"fmt": "parquet", "path": topic}, {"fmt": "parquet", "path": out, "available_now": True}
    watch_job(spark, source, sink).awaitTermination()


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return derived.raw_records(derived.events_table(spark, sf_dir)).cache()


def test_halves_of_one_parse_are_those_of_two(spark, raw):
    judged = cut_lineage(judge_flows(raw))
    names = [n for n in FLOWS.names if n != "ingest_time"]
    assert sorted(accepted_flows(judged).select(names).collect(), key=repr) == sorted(
        parse_flows(raw).select(names).collect(), key=repr
    )
    rejects = rejected_records(judged)
    assert rejects.columns == raw.columns
    assert sorted(rejects.collect(), key=repr) == sorted(parse_rejects(raw).collect(), key=repr)


def test_a_record_is_parsed_once_for_both_halves(spark, raw):
    judged = judge_flows(raw)
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Generate inline(array(struct(_typed") == 1
    stored = cut_lineage(judged)
    for half in (accepted_flows(stored), rejected_records(stored)):
        assert "from_json" not in half._jdf.queryExecution().optimizedPlan().toString()


def test_quarantine_gives_each_half_once_also_after_a_failure(spark, raw, tmp_path, monkeypatch):
    from rillwatch.streaming import quarantine

    topic, good, bad, checkpoint = (str(tmp_path / n) for n in ("topic", "good", "bad", "state"))
    write_topic(raw, RAW_TOPIC, fmt="parquet", path=topic)
    source = {"fmt": "parquet", "path": topic}

    def run():
        quarantine_job(spark, source, good, bad, checkpoint, available_now=True).awaitTermination()

    published = quarantine.publish_batch

    def fail_between(rows, path, number):
        if path == bad:
            raise OSError("disk full")
        return published(rows, path, number)

    monkeypatch.setattr(quarantine, "publish_batch", fail_between)
    with pytest.raises(Exception, match="disk full"):
        run()
    monkeypatch.setattr(quarantine, "publish_batch", published)
    for _ in range(2):
        run()
        assert read_results(spark, good, FLOWS).count() == parse_flows(raw).count()
        assert read_results(spark, bad, TOPIC_ROWS).count() == parse_rejects(raw).count()
    # the stored batches are gone
    assert subfolders(spark, f"{checkpoint}-batches") == []


def test_aggregates_have_a_quarantine_too(spark, tmp_path):
    topic, good, bad, checkpoint = (str(tmp_path / n) for n in ("topic", "good", "bad", "state"))
    values = ['{"bytes_inbound":1}', "{bad", None, '{"bytes_inbound":[1]}']
    rows = spark.createDataFrame([("k", v) for v in values], "key STRING, value STRING")
    write_topic(rows, AGGREGATED_TOPIC, fmt="parquet", path=topic)
    quarantine_job(
        spark, {"fmt": "parquet", "path": topic}, good, bad, checkpoint, AGGREGATED_TOPIC, available_now=True
    ).awaitTermination()
    assert [r.bytes_inbound for r in spark.read.parquet(good).collect()] == [1]
    assert sorted(map(str, (r.value for r in read_results(spark, bad, TOPIC_ROWS).collect()))) == sorted(map(str, values[1:]))


def test_publishing_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "results" / "batch=0")
    assert publish(spark.range(3), path) and not publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    other = str(tmp_path / "results" / "batch=1")
    with pytest.raises(Exception, match="no"):
        publish(broken, other)
    assert subfolders(spark, str(tmp_path / "results")) == ["batch=0"]
    assert read_results(spark, str(tmp_path / "results"), "id BIGINT").count() == 3
    assert read_results(spark, str(tmp_path / "nothing"), "id BIGINT").columns == ["id", "batch"]


# ---------------------------------------------------------------- late records


def _arrivals(spark, sf_dir):
    return derived.arrivals(derived.events_table(spark, sf_dir)).select(
        F.col("pkt_seq").cast("string").alias("value"),
        F.col("source_partition").alias("partition"),
        (F.col("arrival") * 1_000_000 + F.col("pkt_seq")).alias("offset"),
        "timestamp",
    )


def _on_time(spark, topic, tmp_path, window="1 hour"):
    kept, checkpoint = str(tmp_path / "kept"), str(tmp_path / "state")
    source = {"fmt": "parquet", "path": topic, "maxFilesPerTrigger": "1"}
    on_time_job(spark, source, kept, checkpoint, window, available_now=True).awaitTermination()
    return sorted(int(r.value) for r in read_results(spark, kept, TOPIC_ROWS).collect())


def test_late_rule_of_a_stream_is_that_of_a_batch(spark, sf_dir, tmp_path):
    records = _arrivals(spark, sf_dir).cache()
    topic = str(tmp_path / "topic")
    cuts = [r[0] for r in records.orderBy("offset").select("offset").collect()][:: records.count() // 5 + 1]
    for low, high in zip(cuts, [*cuts[1:], 2**62]):
        part = records.where(F.col("offset").between(low, high - 1))
        write_topic(part.coalesce(1), RAW_TOPIC, fmt="parquet", path=topic)
        # a run for each file: every one is a restart
        got = _on_time(spark, topic, tmp_path)
    wanted = drop_late(records, "1 hour", ("offset",), "partition", chunk_rows=10**9)
    assert got == sorted(int(r.value) for r in wanted.collect())
    assert 0 < len(got) < records.count()


def test_records_without_offsets_arrive_in_the_order_of_files(spark, sf_dir, tmp_path):
    records = _arrivals(spark, sf_dir).cache()
    topic = str(tmp_path / "topic")
    ordered = records.orderBy("offset").collect()
    size = len(ordered) // 4 + 1
    for begin in range(0, len(ordered), size):
        part = spark.createDataFrame(ordered[begin : begin + size], records.schema).drop("offset").coalesce(1)
        write_topic(part, RAW_TOPIC, fmt="parquet", path=topic)
    read = in_file_order(read_topic(spark, RAW_TOPIC, fmt="parquet", path=topic, places=True))
    assert read.columns == [*TOPIC_ROWS.names] or set(read.columns) == set(TOPIC_ROWS.names)
    assert [r.value for r in read.orderBy("offset").collect()] == [r.value for r in ordered]
    wanted = drop_late(records, "1 hour", ("offset",), "partition", chunk_rows=10**9)
    wanted = sorted(int(r.value) for r in wanted.collect())
    assert sorted(int(r.value) for r in drop_late(read, "1 hour", source_partition="partition").collect()) == wanted
    assert _on_time(spark, topic, tmp_path) == wanted


def test_stream_time_outlives_a_batch_without_a_source(spark, tmp_path):
    topic = str(tmp_path / "topic")

    def put(*rows):
        made = spark.createDataFrame(rows, "value STRING, partition INT, offset BIGINT, t STRING")
        write_topic(made.withColumn("timestamp", F.col("t").cast("timestamp")), RAW_TOPIC, fmt="parquet", path=topic)

    put(("1", 0, 0, "2024-01-01 05:00:00"), ("2", None, 0, "2024-01-01 09:00:00"))
    assert _on_time(spark, topic, tmp_path) == [1, 2]
    put(("3", 1, 0, "2024-01-01 01:00:00"))
    assert _on_time(spark, topic, tmp_path) == [1, 2, 3]
    put(("4", 0, 1, "2024-01-01 04:59:59"), ("5", 0, 2, "2024-01-01 05:30:00"), ("6", None, 1, "2024-01-01 08:00:00"))
    assert _on_time(spark, topic, tmp_path) == [1, 2, 3, 5]


# ---------------------------------------------------------------- delivery and restarts


def _warning_topic(spark, path, texts):
    rows = [("k", json.dumps({"severidade": "alta", "descricao": t})) for t in texts]
    write_topic(spark.createDataFrame(rows, "key STRING, value STRING"), WARNINGS_TOPIC, fmt="parquet", path=path)
    return {"fmt": "parquet", "path": path}


def test_alerts_are_delivered_once_and_dead_letters_kept(spark, tmp_path):
    topic, outcomes, checkpoint, log = (str(tmp_path / n) for n in ("topic", "outcomes", "state", "log"))
    os.mkdir(log)
    source = _warning_topic(spark, topic, ["a", "b", "never", "c"])
    downs = []

    def connect():
        downs.append(1)
        if len(downs) <= 2:
            raise ConnectionError("down")

    def send(alert):
        with open(f"{log}/{alert['text']}", "a") as file:
            file.write(f"{alert['delivery_id']}\n")
        if alert["text"] == "never":
            raise ValueError("refused")

    def run():
        return alert_job(
            spark, source, send, outcomes, checkpoint, tries=2, connect=connect, available_now=True, pause=0.0
        )

    schema = run()
    _warning_topic(spark, topic, ["d"])
    run()
    taken = delivered(spark, outcomes, schema)
    assert sorted(r.text for r in taken.collect()) == ["a", "b", "c", "d"]
    dead = dead_letters(spark, outcomes, schema).collect()
    assert [(r.text, r.error) for r in dead] == [("never", "ValueError: refused")]
    tried = {name: open(f"{log}/{name}").read().split() for name in os.listdir(log)}
    assert {name: len(ids) for name, ids in tried.items()} == {"a": 1, "b": 1, "c": 1, "d": 1, "never": 2}
    assert len({ids[0] for ids in tried.values()}) == 5


def test_a_batch_whose_commit_failed_is_not_sent_again(spark, tmp_path, monkeypatch):
    """The outcomes are there, the stream's own commit is not: the batch comes again and is skipped."""
    from rillwatch.streaming import batches

    topic, outcomes, checkpoint, log = (str(tmp_path / n) for n in ("topic", "outcomes", "state", "log"))
    source = _warning_topic(spark, topic, ["a", "b"])

    def send(alert):
        with open(log, "a") as file:
            file.write(alert["text"])

    def run():
        rows = read_topic(spark, WARNINGS_TOPIC, stream=True, **source).select("value", F.col("value").alias("text"))
        deliver_once(rows, send, outcomes, checkpoint, available_now=True).awaitTermination()

    removed = batches.remove_folder
    monkeypatch.setattr(batches, "remove_folder", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    sent = open(log).read()
    monkeypatch.setattr(batches, "remove_folder", removed)
    run()
    assert open(log).read() == sent


def test_a_receiver_that_goes_down_fails_the_batch(spark, tmp_path):
    source = _warning_topic(spark, str(tmp_path / "topic"), ["a"])
    outcomes = str(tmp_path / "outcomes")

    def send(alert):
        raise ReceiverDown("gone")

    with pytest.raises(Exception, match="gone"):
        alert_job(
            spark, source, send, outcomes, str(tmp_path / "state"), available_now=True, restarts=2, pause=0.0
        )
    assert subfolders(spark, outcomes) == []


def test_a_query_that_fails_twice_ends_with_its_full_result(spark, tmp_path):
    topic, out, checkpoint = (str(tmp_path / n) for n in ("topic", "out", "state"))
    for part in range(3):
        _warning_topic(spark, topic, [f"{part}{n}" for n in range(4)])
    seen, pauses = [], []

    def write(batch, number):
        seen.append(number)
        if seen.count(number) <= 2 and number == 1:
            raise ValueError("not now")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def start():
        rows = read_topic(spark, WARNINGS_TOPIC, fmt="parquet", path=topic, stream=True, maxFilesPerTrigger="4")
        return stored_batches(rows, write, checkpoint, available_now=True)

    supervise(start, tries=3, pause=1.0, sleep=pauses.append)
    rows = read_results(spark, out, TOPIC_ROWS)
    assert rows.count() == rows.select("value").distinct().count() == 12
    assert seen.count(1) == 3 and pauses == [1.0, 2.0]


def test_failures_without_progress_are_bounded(spark, tmp_path):
    topic, pauses = str(tmp_path / "topic"), []
    source = _warning_topic(spark, topic, ["a"])

    def write(batch, number):
        raise ValueError("never")

    def start():
        rows = read_topic(spark, WARNINGS_TOPIC, stream=True, **source)
        return stored_batches(rows, write, str(tmp_path / "state"), available_now=True)

    with pytest.raises(Exception, match="never"):
        supervise(start, tries=4, pause=1.0, longest_pause=3.0, sleep=pauses.append)
    assert pauses == [1.0, 2.0, 3.0]


# ---------------------------------------------------------------- starting place


def test_an_incomplete_starting_place_is_an_error(spark, tmp_path):
    topic, out, checkpoint = (str(tmp_path / n) for n in ("topic", "out", "state"))
    rows = aggregate_records(aggregate_rows(spark, [(0, 1, 1, 1)]))
    write_topic(rows, AGGREGATED_TOPIC, fmt="parquet", path=topic)
    sink = {"fmt": "parquet", "path": out, "checkpoint": checkpoint, "available_now": True}
    os.makedirs(f"{checkpoint}-position/_temporary")
    with pytest.raises(ValueError, match="incomplete"):
        split_job(spark, {"fmt": "parquet", "path": topic}, sink)


# ---------------------------------------------------------------- detector state


def _windows(spark, values, first=0):
    return aggregate_rows(spark, [(first + n, v, 10, 3) for n, v in enumerate(values)])


def test_detection_goes_on_from_a_batch(spark, tmp_path):
    values = [100 + 7 * n % 50 + (300 if n % 9 == 8 else 0) for n in range(80)]
    whole = _windows(spark, values)
    earlier, later = _windows(spark, values[:50]), _windows(spark, values[50:], 50)
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    later.where(F.col("window_start") < later.agg(F.max("window_start")).first()[0]).write.parquet(folder)
    stream = spark.readStream.schema(whole.schema).parquet(folder)
    table = str(tmp_path / "out")
    drain(stream_rolling_anomalies(stream, earlier=earlier), table, checkpoint)
    # a restart goes on with its own state, not with the batch
    later.orderBy(F.desc("window_start")).limit(1).write.mode("append").parquet(folder)
    found = drain(stream_rolling_anomalies(stream, earlier=earlier), table, checkpoint)
    expected = sorted(rolling_anomalies(whole).collect())
    assert sorted(rolling_anomalies(earlier).collect() + found.collect()) == expected
    held = {r.metric: r["values"] for r in detector_state(spark, checkpoint).collect()}
    assert held["bytes_inbound"] == values[-30:]


def test_a_key_that_is_idle_begins_anew(spark, tmp_path):
    import time

    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = _windows(spark, [1]).schema

    def run(values, first):
        _windows(spark, values, first).coalesce(1).write.mode("append").parquet(folder)
        stream = stream_rolling_anomalies(spark.readStream.schema(schema).parquet(folder), idle="3 seconds")
        query = (
            stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start(table)
        )
        # with times to live a query never comes to an end by itself
        for _ in range(120):
            if any(p.numInputRows for p in query.recentProgress):
                break
            time.sleep(0.5)
        query.stop()
        return spark.read.schema(stream.schema).parquet(table)

    run([100] * 10, 0)
    time.sleep(4)
    # with its history this window would be far above the mean
    assert run([1000], 10).count() == 0
    held = {r.metric: r["values"] for r in detector_state(spark, checkpoint).collect()}
    assert held["bytes_inbound"] == [1000]


def test_a_failed_metric_keeps_its_history(spark, tmp_path, monkeypatch):
    from rillwatch.streaming import detector

    class Fragile(detector.RollingDetector):
        def _check(self, key, starts, metric, series, known):
            if metric == "bytes_inbound" and series[-1] == 777:
                raise ValueError("broken")
            return super()._check(key, starts, metric, series, known)

    monkeypatch.setattr(detector, "RollingDetector", Fragile)
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for values, first in (([5, 6], 0), ([777], 2)):
        rows = _windows(spark, values, first)
        rows.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        drain(stream_rolling_anomalies(stream), table, checkpoint)
    held = {r.metric: r["values"] for r in detector_state(spark, checkpoint).collect()}
    assert held["bytes_inbound"] == [5, 6] and held["bytes_outbound"] == [10, 10, 10]
    before = {r.metric: r["values"] for r in detector_state(spark, checkpoint, batch=0).collect()}
    assert before["bytes_outbound"] == [10, 10]


# ---------------------------------------------------------------- metrics and sketches


def test_metrics_of_a_stream_are_kept_batch_by_batch(spark, tmp_path):
    folder, metrics = str(tmp_path / "in"), str(tmp_path / "metrics")
    for size in (3, 5, 7):
        spark.range(size).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id BIGINT").option("maxFilesPerTrigger", "1").parquet(folder)
    with MetricsRecorder(spark, metrics) as recorder:
        query = (
            tap(stream, "seen", largest=F.max("id"))
            .writeStream.format("noop")
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        recorder.wait(query)
    got = {(r.point, r.metric): (r.batches, r.value) for r in metric_totals(spark, metrics).collect()}
    assert got == {("seen", "rows"): (3, 15.0), ("seen", "largest"): (3, 2.0 + 4 + 6)}


def test_sketches_merge_and_stay_within_their_error(spark, tmp_path):
    made = spark.range(60_000).select(
        F.lit("a").alias("src_ip"),
        (F.col("id") % 30_011).alias("src_port"),
        F.lit("b").alias("dst_ip"),
        F.when(F.col("id") % 2 == 0, F.lit(1)).alias("dst_port"),
        F.lit("TCP").alias("protocol"),
        F.timestamp_seconds(F.lit(1_699_920_000) + F.col("id") % 7200).alias("timestamp"),
    )
    folder = str(tmp_path / "in")
    made.write.parquet(folder)
    flows = spark.read.parquet(folder)
    parts = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")
    hours = flow_sketches(flows, "1 hour")
    assert all(len(r.sketch) < 6000 for r in hours.collect())
    day = union_sketches(hours, "1 day").select(estimated_flows().alias("n")).first().n
    exact = flows.select(*parts).distinct().count()
    assert exact == 60_000 and abs(day - exact) <= 5 * standard_error() * exact
    stream = flow_sketches(spark.readStream.schema(flows.schema).parquet(folder), "1 hour", watermark="0 seconds")
    closed = {r.window_start: r.n for r in drain(stream).select("window_start", estimated_flows().alias("n")).collect()}
    batch = {r.window_start: r.n for r in hours.select("window_start", estimated_flows().alias("n")).collect()}
    assert closed and all(abs(batch[w] - n) <= 0.1 * batch[w] for w, n in closed.items())


# ---------------------------------------------------------------- event time through Kafka


def test_event_time_travels_as_a_header(spark):
    """Rows for the writer, as the reader would deliver them, back to records; no broker in between."""
    from rillwatch.sources.sinks import _kafka_rows
    from rillwatch.sources.topics import _kafka_records

    records = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp'2024-01-01 10:00:00.123456'), ('b', NULL) AS t(value, timestamp)"
    ).withColumn("key", F.lit(None).cast("string"))
    sent = _kafka_rows(records, RAW_TOPIC, event_time=True)
    assert dict(sent.dtypes)["headers"] == "array<struct<key:string,value:binary>>"
    foreign = F.expr("array(named_struct('key', 'other', 'value', cast('1' AS binary)), "
                     "named_struct('key', 'event-time-us', 'value', cast('no number' AS binary)))")  # fmt: skip
    arrived = sent.unionByName(sent.where("value = 'a'").withColumns({"value": F.lit("c"), "headers": foreign}))
    received = F.lit("2024-05-05 00:00:00").cast("timestamp")
    arrived = arrived.select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "topic",
        F.lit(0).alias("partition"), F.lit(1).cast("bigint").alias("offset"), received.alias("timestamp"), "headers",
    )
    got = {r.value: str(r.timestamp) for r in _kafka_records(arrived, True).collect()}
    assert got == {"a": "2024-01-01 10:00:00.123456", "b": "2024-05-05 00:00:00", "c": "2024-05-05 00:00:00"}
    assert {str(r.timestamp) for r in _kafka_records(arrived, False).collect()} == {"2024-05-05 00:00:00"}
    assert _kafka_records(arrived, True).schema.names == TOPIC_ROWS.names
