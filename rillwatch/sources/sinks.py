"""Topic writers, batch and streaming."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse_warnings
from ..operators.route import alert_messages
from ..schemas import EVENT_TIME_HEADER, TOPIC_ROWS
from ..session import new_folder, state_partitions


def _topic_rows(records: DataFrame, topic: str | None) -> DataFrame:
    """Complete the columns of a file topic; ``offset`` is not assigned by a file write."""
    given = set(records.columns)

    def column(name: str, kind: str) -> Column:
        if name == "topic" and topic is not None:
            return F.lit(topic).alias(name)
        if name in given:
            return F.col(name).cast(kind).alias(name)
        if name == "timestamp":
            return F.current_timestamp().alias(name)
        return F.lit(None).cast(kind).alias(name)

    return records.select(*[column(f.name, f.dataType.simpleString()) for f in TOPIC_ROWS])


def _kafka_rows(records: DataFrame, topic: str | None, event_time: bool = False) -> DataFrame:
    """Rows of the Kafka writer; with ``event_time`` the record's ``timestamp`` travels as a header.

    Kafka gives a record the time at which it was sent. A consumer that counts in event time asks for the
    header (``read_topic(..., event_time=True)``).
    """
    target = F.lit(topic) if topic is not None else F.col("topic")
    columns = [
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        target.alias("topic"),
    ]
    if event_time:
        micros = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("string").cast("binary")
        header = F.struct(F.lit(EVENT_TIME_HEADER).alias("key"), micros.alias("value"))
        columns.append(F.when(F.col("timestamp").isNotNull(), F.array(header)).alias("headers"))
    return records.select(*columns)


def write_topic(
    records: DataFrame,
    topic: str | None = None,
    fmt: str = "kafka",
    path: str | None = None,
    event_time: bool = False,
    **options: str,
) -> None:
    """Append ``records`` (key, value and, unless ``topic`` is given, topic) to their topics.

    ``event_time`` sends the column ``timestamp`` along to Kafka; file topics keep it anyway.
    """
    if fmt == "kafka":
        _kafka_rows(records, topic, event_time).write.format("kafka").options(**options).save()
    else:
        writer = _topic_rows(records, topic).write.format(fmt).options(**options)
        writer.partitionBy("topic").mode("append").save(path)


def stream_topic(
    records: DataFrame,
    topic: str | None = None,
    fmt: str = "kafka",
    path: str | None = None,
    checkpoint: str | None = None,
    name: str | None = None,
    available_now: bool = False,
    interval: str = "10 seconds",
    partitions: int | None = None,
    event_time: bool = False,
    **options: str,
) -> StreamingQuery:
    """Start appending a stream of records to their topics, to Kafka with their ``event_time`` if wanted.

    ``checkpoint`` is what makes the stream restartable, so a lasting stream needs one.
    ``available_now`` works off what is there and stops; it may do without. ``partitions`` is the
    number of state partitions, by default that of the session's shuffles.
    """
    spark = records.sparkSession
    checkpoint = _checkpoint(spark, checkpoint, available_now)
    rows = _kafka_rows(records, topic, event_time) if fmt == "kafka" else _topic_rows(records, topic)
    writer = (
        rows.writeStream.format(fmt)
        .outputMode("append")
        .options(**options)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    if name:
        writer = writer.queryName(name)
    with state_partitions(spark, partitions):
        return writer.start() if fmt == "kafka" else writer.partitionBy("topic").start(path)


def _checkpoint(spark: SparkSession, checkpoint: str | None, available_now: bool) -> str:
    if checkpoint is None and not available_now:
        raise ValueError("a lasting stream needs a checkpoint folder, or a restart would begin anew")
    return checkpoint or new_folder(spark, "stream")


def each_batch(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand every micro-batch and its number to ``write``.

    A batch whose write failed comes again with the same number, so a writer that remembers the last
    number it has finished delivers each batch once.
    """
    location = _checkpoint(rows.sparkSession, checkpoint, available_now)
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", location)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deliver_alerts(
    raw_warnings: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand each micro-batch of alerts and its number to ``write``, one row per readable warning."""
    return each_batch(alert_messages(parse_warnings(raw_warnings)), write, checkpoint, available_now)
