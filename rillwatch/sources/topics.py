"""Topics as tables and streams.

A topic is either a Kafka topic (``fmt="kafka"``, with ``kafka.bootstrap.servers`` among the
options; needs the connector package on the cluster) or a folder of files with the columns
key, value, topic, partition, offset and timestamp, written by :mod:`rillwatch.sources.sinks`.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.parse import parse_aggregates, parse_flows, parse_warnings
from ..schemas import AGGREGATED_TOPIC, EVENT_TIME_HEADER, FRAMES, PACKETS, RAW_TOPIC, TOPIC_ROWS, WARNINGS_TOPIC
from ..session import folder_exists, new_folder, publish

# where a record lies in a file topic
PLACE = ("_modified", "_file", "_row")


def _files_at_start(spark: SparkSession, fmt: str, path: str, position: str) -> DataFrame:
    """Files of a topic when a stream with this position first started; later starts read the same list.

    The list appears under its name in one step, complete. What stands there and can't be read is an error:
    taking it for a first start would skip what was written while the stream was down.
    """
    if not folder_exists(spark, position):
        rows = spark.read.schema(TOPIC_ROWS).format(fmt).load(path)
        publish(rows.select(F.col("_metadata.file_path").alias("_file")).distinct(), position)
    elif not folder_exists(spark, f"{position.rstrip('/')}/_SUCCESS"):
        raise ValueError(f"the starting place {position} is incomplete: restore it, or remove it to start anew")
    return spark.read.schema("_file STRING").parquet(position)


def _kafka_records(rows: DataFrame, event_time: bool) -> DataFrame:
    """Rows of the Kafka reader to topic records."""
    when = F.col("timestamp")
    if event_time:
        named = F.filter("headers", lambda h: h["key"] == EVENT_TIME_HEADER)
        micros = F.get(named, F.lit(0))["value"].cast("string").try_cast("bigint")
        when = F.coalesce(F.timestamp_micros(micros), when)
    return rows.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        when.alias("timestamp"),
    )


def in_file_order(records: DataFrame) -> DataFrame:
    """Records with the place columns of ``read_topic(..., places=True)`` to records with an ``offset``.

    Files count in the order in which they were written (by name where that time is equal), rows as they
    lie in their file. A given offset stays. Pass a stored table or a batch read: it is read twice.
    """
    files = records.select("_modified", "_file").distinct()
    # one row per file
    numbered = files.withColumn("_number", F.row_number().over(Window.orderBy("_modified", "_file")))
    placed = records.join(numbered.select("_file", "_number"), "_file", "left")
    sequence = F.shiftleft(F.col("_number").cast("bigint"), 32) + F.col("_row")
    return placed.withColumn("offset", F.coalesce("offset", sequence)).drop(*PLACE, "_number")


def read_topic(
    spark: SparkSession,
    topic: str,
    fmt: str = "kafka",
    path: str | None = None,
    stream: bool = False,
    starting: str = "earliest",
    position: str | None = None,
    places: bool = False,
    event_time: bool = False,
    **options: str,
) -> DataFrame:
    """Records of a topic with text key and value.

    With ``event_time`` the ``timestamp`` of a Kafka record is the event time that its writer sent along,
    where it did, and not the time of sending; file topics have no other.

    File topics that were written without offsets still have an order: with ``places`` each record of a
    Parquet topic has the time and name of its file and its row in it, for :func:`in_file_order`.

    ``starting="latest"`` skips what the topic holds when the stream first starts and nothing that is
    written later, whatever its time. Kafka keeps that place in the stream's checkpoint; for files it is
    the list of the files then there, kept in the folder ``position``. Pass the same folder at a
    restart, so that what was written in between is read; by default each call is a first start.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError(f"starting must be 'earliest' or 'latest', not {starting!r}")
    if starting == "latest" and not stream:
        raise ValueError("a batch read has no later records: use starting='earliest'")
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    if fmt == "kafka":
        reader = reader.option("subscribe", topic).option("startingOffsets", starting)
        return _kafka_records(reader.option("includeHeaders", str(event_time).lower()).load(), event_time)
    if path is None:
        raise ValueError("a file topic needs its path")
    records = reader.schema(TOPIC_ROWS).load(path).where(F.col("topic") == topic)
    found = dict(zip(PLACE, ("file_modification_time", "file_path", "row_index")))
    wanted = [name for name in PLACE if places or (starting == "latest" and name == "_file")]
    named = records.select(*TOPIC_ROWS.names, *[F.col(f"_metadata.{found[n]}").alias(n) for n in wanted])
    if starting == "latest":
        known = _files_at_start(spark, fmt, path, position or new_folder(spark, "position"))
        named = named.join(known, "_file", "left_anti")
    return named.select(*TOPIC_ROWS.names, *(PLACE if places else ()))


def read_flows(spark: SparkSession, **source) -> DataFrame:
    """Parsed flows of the raw topic, from the earliest record."""
    return parse_flows(read_topic(spark, RAW_TOPIC, **source))


def read_aggregates(spark: SparkSession, **source) -> DataFrame:
    """Parsed aggregates; pass ``starting="latest"`` for new ones only."""
    return parse_aggregates(read_topic(spark, AGGREGATED_TOPIC, **source))


def read_warnings(spark: SparkSession, **source) -> DataFrame:
    """Parsed warnings: a stream starts at new records, a batch read takes all."""
    source.setdefault("starting", "latest" if source.get("stream") else "earliest")
    return parse_warnings(read_topic(spark, WARNINGS_TOPIC, **source))


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Table of captured frames."""
    return (spark.readStream if stream else spark.read).schema(FRAMES).parquet(path)


def read_packets(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Table of decoded packets."""
    return (spark.readStream if stream else spark.read).schema(PACKETS).parquet(path)
