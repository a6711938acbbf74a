"""Micro-batches as tables: each one's results appear once, whatever fails in between.

A result table is a folder with one subfolder ``batch=N`` per micro-batch. A subfolder is written beside
its place and renamed, so it is complete or absent, and its being there is the ledger: a micro-batch that
comes again after a failure finds it and leaves it alone.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import folder_exists, publish, remove_folder, subfolders
from ..sources import each_batch

_BATCH = "batch="


def batch_folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{_BATCH}{number}"


def publish_batch(rows: DataFrame, path: str, number: int) -> bool:
    """Add the result of a micro-batch to a result table; False if it is there already."""
    return publish(rows, batch_folder(path, number))


def has_batch(spark: SparkSession, path: str, number: int) -> bool:
    return folder_exists(spark, batch_folder(path, number))


def last_batch(spark: SparkSession, path: str, before: int) -> int | None:
    """Number of the latest result before the given micro-batch."""
    names = (n.removeprefix(_BATCH) for n in subfolders(spark, path) if n.startswith(_BATCH))
    return max((int(n) for n in names if int(n) < before), default=None)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A result table with all its micro-batches and their number in ``batch``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    # without any finished batch there is no folder to read
    if not subfolders(spark, path):
        return spark.createDataFrame([], numbered)
    return spark.read.schema(numbered).parquet(path)


def stored_batches(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand every micro-batch to ``write`` as a stored table, which it may read any number of times.

    What comes before the sink (a parse, say) is computed once per micro-batch. The table of a batch is
    published like a result, so a batch that comes again is read from it, and goes when ``write`` returns.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint.rstrip('/')}-batches"

    def store(batch: DataFrame, number: int) -> None:
        publish_batch(batch, folder, number)
        at = batch_folder(folder, number)
        write(spark.read.schema(batch.schema).parquet(at), number)
        remove_folder(spark, at)

    return each_batch(rows, store, checkpoint, available_now)
