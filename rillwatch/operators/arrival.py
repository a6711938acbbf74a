"""Late records in arrival order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import WINDOW
from ..session import cut_lineage
from .ordered import running

CHUNK_ROWS = 1_000_000


def drop_late(
    flows: DataFrame,
    window: str = WINDOW,
    arrival: Sequence[str] = ("offset",),
    source_partition: str | None = None,
    time: str = "timestamp",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Keep the records whose window was still open when they arrived (no grace period).

    Stream time is the latest ``time`` seen so far, the record itself included, per source
    partition. A record is late when its window ends at or before stream time. ``arrival`` orders
    the records; its first column must be a sequence number (an offset), which cuts long sources
    into pieces of ``chunk_rows``. A record without one has no place in the order and is an error.
    The records are stored first, as they are read twice.
    """
    return on_time(cut_lineage(flows), window, arrival, source_partition, time, chunk_rows)


def source_name(source_partition: str | None) -> Column:
    """Name of a record's source; records without a partition form a source of their own."""
    source = F.col(source_partition).cast("string") if source_partition else F.lit("all")
    return F.coalesce(source, F.lit("none"))


def on_time(
    stored: DataFrame,
    window: str = WINDOW,
    arrival: Sequence[str] = ("offset",),
    source_partition: str | None = None,
    time: str = "timestamp",
    chunk_rows: int = CHUNK_ROWS,
    before: DataFrame | None = None,
) -> DataFrame:
    """:func:`drop_late` on a stored table; ``before`` has each source's stream time (source,
    stream_time) as earlier records left it, one row a source."""
    rows = stored.withColumn("_source", source_name(source_partition))
    missing = F.raise_error(F.lit(f"a record has no {arrival[0]}: pass columns that order the records"))
    chunk: Column = F.floor(F.coalesce(F.col(arrival[0]), missing.cast("bigint")) / chunk_rows)
    seen = running(rows, ["_source"], arrival, chunk, {"_stream_time": ("max", time)})
    if before is not None:
        known = before.select(F.col("source").alias("_source"), F.col("stream_time").alias("_before"))
        later = F.greatest("_stream_time", "_before").alias("_stream_time")
        seen = seen.join(known, "_source", "left").select(*rows.columns, later)
    return (
        seen.withColumn("_window", F.window(time, window))
        .where(F.col("_window.end") > F.col("_stream_time"))
        .drop("_window", "_stream_time", "_source")
    )
