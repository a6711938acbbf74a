"""The applications chained through file topics."""

from pyspark.sql import functions as F

from rillwatch.operators import decode_frames, packet_traffic, rolling_anomalies
from rillwatch.plans import derived
from rillwatch.schemas import FRAMES, SUMMARY_TOPICS, WARNINGS_TOPIC
from rillwatch.session import cut_lineage
from rillwatch.sources import read_frames, read_topic
from rillwatch.streaming import (
    aggregate_job,
    capture_job,
    limit_job,
    split_job,
    view_job,
    watch_job,
)

NETWORK = (derived.LOCAL_NET, derived.LOCAL_MASK)


def test_frames_to_alerts_through_every_topic(spark, sf_dir, tmp_path):
    def topic(name):
        return {"fmt": "parquet", "path": str(tmp_path / name)}

    def sink(name):
        return {**topic(name), "available_now": True}

    frames = derived.frames(derived.events_table(spark, sf_dir)).select(FRAMES.names)
    frames.write.parquet(str(tmp_path / "frames"))
    stream = read_frames(spark, str(tmp_path / "frames"), stream=True)
    capture_job(stream, *NETWORK, sink("raw"), tick="1 hour").awaitTermination()
    aggregate_job(spark, topic("raw"), sink("aggregates"), window="6 hours").awaitTermination()
    watch_job(spark, topic("aggregates"), sink("warnings")).awaitTermination()
    got = read_topic(spark, WARNINGS_TOPIC, **topic("warnings"))

    # the last tick never closes, nor does the window its predecessor lies in
    ticks = decode_frames(frames).agg(F.max(F.window("ts", "1 hour")["start"])).first()[0]
    traffic = packet_traffic(
        decode_frames(frames).where(F.col("ts") < F.lit(ticks)), *NETWORK, window="6 hours", tick="1 hour"
    )
    closed = traffic.where(F.col("window_end") <= traffic.select(F.max("timestamp_end")).scalar())
    expected = rolling_anomalies(cut_lineage(closed))
    assert got.count() == expected.count() > 5

    earliest = {**topic("aggregates"), "starting": "earliest"}
    split_job(spark, earliest, sink("summaries")).awaitTermination()
    for name in SUMMARY_TOPICS.values():
        assert read_topic(spark, name, **topic("summaries")).count() == closed.count()

    limits, alerts = str(tmp_path / "limits"), str(tmp_path / "alerts")

    def store(path):
        return lambda batch, number: batch.write.mode("append").parquet(path)

    limit_job(
        spark, earliest, store(limits), available_now=True, bytes_in=0, bytes_out=10**9, unique_flows=10**9
    ).awaitTermination()
    assert spark.read.parquet(limits).count() == closed.where("bytes_inbound > 0").count()
    view_job(
        spark, {**topic("warnings"), "starting": "earliest"}, store(alerts), available_now=True
    ).awaitTermination()
    assert spark.read.parquet(alerts).count() == expected.count()
