"""The exact late rule on a stream.

Spark's watermark moves once per micro-batch and knows one time for the whole stream. The rule here is that
of :func:`rillwatch.operators.drop_late`: every record moves the stream time of its source partition, and a
record is late if its window has ended by then. State is one stream time per source, kept as a result table
beside the checkpoint. A micro-batch is judged in pieces along its offsets (see
:mod:`rillwatch.operators.ordered`), so a source's records are spread over many tasks and never gathered.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.arrival import CHUNK_ROWS, on_time, source_name
from ..schemas import RAW_TOPIC, WINDOW
from ..session import configure
from ..sources import in_file_order, read_topic
from .batches import batch_folder, last_batch, publish_batch, stored_batches

_TIMES = "source STRING, stream_time TIMESTAMP"


def _stream_times(rows: DataFrame, before: DataFrame, source_partition: str | None, time: str) -> DataFrame:
    seen = rows.select(source_name(source_partition).alias("source"), F.col(time).alias("stream_time"))
    return seen.unionByName(before).groupBy("source").agg(F.max("stream_time").alias("stream_time"))


def stream_drop_late(
    records: DataFrame,
    path: str,
    checkpoint: str,
    window: str = WINDOW,
    arrival: Sequence[str] = ("offset",),
    source_partition: str | None = None,
    time: str = "timestamp",
    chunk_rows: int = CHUNK_ROWS,
    available_now: bool = False,
) -> StreamingQuery:
    """Add the records of a stream that came on time to the result table ``path``.

    Arguments are those of the batch rule. Records of one source partition must reach the stream in the
    order of ``arrival`` from micro-batch to micro-batch, as topics deliver them; within a micro-batch any
    order will do. Records read with ``places=True`` are put into the order of their files.
    """
    spark = records.sparkSession
    times = f"{checkpoint.rstrip('/')}-stream-time"

    def write(batch: DataFrame, number: int) -> None:
        rows = in_file_order(batch) if "_row" in batch.columns else batch
        known = last_batch(spark, times, number)
        before = spark.createDataFrame([], _TIMES)
        if known is not None:
            before = spark.read.schema(_TIMES).parquet(batch_folder(times, known))
        kept = on_time(rows, window, arrival, source_partition, time, chunk_rows, before)
        publish_batch(kept, path, number)
        publish_batch(_stream_times(rows, before, source_partition, time).coalesce(1), times, number)

    return stored_batches(records, write, checkpoint, available_now)


def on_time_job(
    spark: SparkSession,
    source: dict,
    path: str,
    checkpoint: str,
    window: str = WINDOW,
    available_now: bool = False,
) -> StreamingQuery:
    """Raw topic to the records of it that came on time, per partition of the topic."""
    configure(spark)
    places = source.get("fmt", "kafka") != "kafka"
    records = read_topic(spark, RAW_TOPIC, stream=True, places=places, **source)
    return stream_drop_late(
        records, path, checkpoint, window, source_partition="partition", available_now=available_now
    )
