"""Running a stream over what is available and reading back its result."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder, state_partitions


def tap(df: DataFrame, name: str, **extra) -> DataFrame:
    """Count the rows passing this point, as observed metric ``name``.``rows``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in extra.items()])


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Stream over a parquet table, a single file or a folder of files."""
    # a plain path streams a folder only; a pattern that matches just this path may name one file
    escaped = re.sub(r"([\\{}\[\]*?,])", r"\\\1", path.rstrip("/"))
    pattern = f"{escaped[:-1]}[{escaped[-1]}]" if re.match(r"\w", escaped[-1]) else escaped
    return spark.readStream.schema(schema).options(**options).parquet(pattern)


def drain(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Run ``stream`` to the end of its available input into a table, and read that table.

    The table and the stream state lie in the shared folder, so a restart with the same
    ``checkpoint`` goes on where the last run stopped. ``partitions`` is the number of its state
    partitions, by default that of the session's shuffles; a checkpoint keeps it for good.
    """
    spark = stream.sparkSession
    schema = stream.schema
    path = path or new_folder(spark, "table")
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or new_folder(spark, "stream"))
        .trigger(availableNow=True)
    )
    with state_partitions(spark, partitions):
        query = writer.start(path)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)
