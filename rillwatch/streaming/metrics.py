"""The counts of running streams, kept as a table."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

METRIC_ROWS = "query STRING, run STRING, batch BIGINT, point STRING, metric STRING, value DOUBLE, at STRING"


class MetricsRecorder(StreamingQueryListener):
    """Appends the observed metrics (see :func:`tap`) of every micro-batch of every query to a table.

    Spark tells of a batch after its commit, in the order of batches, on a thread of its own; ``wait``
    returns when all of a query that has ended are written. A batch that is tried again is told of once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def __enter__(self) -> "MetricsRecorder":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = [
            (str(progress.id), str(progress.runId), progress.batchId, point, metric, float(value), progress.timestamp)
            for point, observed in progress.observedMetrics.items()
            for metric, value in observed.asDict().items()
            if isinstance(value, (int, float))
        ]
        if rows:
            self.spark.createDataFrame(rows, METRIC_ROWS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait until everything that a query which has ended observed is in the table."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError(f"the end of query {query.id} was not told of within {seconds} s")


def metric_totals(spark: SparkSession, path: str) -> DataFrame:
    """point, metric, batches and the sum of the values over all micro-batches."""
    rows = spark.read.schema(METRIC_ROWS).parquet(path)
    return rows.groupBy("point", "metric").agg(
        F.count_distinct("query", "batch").alias("batches"), F.sum("value").alias("value")
    )
