"""Row frames over one long ordered sequence per key, computed in bounded pieces.

A plain ``Window.partitionBy(key)`` sends everything a key has to one task, and the traffic
aggregates have one global key. Here each key's sequence is cut into chunks; what a row needs from
outside its own piece is brought to it, so results are those of the plain window.

Keys must not be NULL. Both functions read ``rows`` twice (once for the chunk summaries, once for the rows): pass a stored
table, a cheap scan or the result of :func:`rillwatch.session.cut_lineage`.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import to_bigint, wide

BLOCK_ROWS = 4096


def _wide_sum(column: str) -> Column:
    return F.sum(wide(F.col(column)))


# sums are of BIGINT columns and stay wide until they are put together
_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_MEASURE = {"sum": _wide_sum, "count": F.count, "min": F.min, "max": F.max}


# chunk of rows without a position; sorts first, as NULL does
_NO_CHUNK = -(2**63)


def _in_chunks(rows: DataFrame, chunk: Column) -> DataFrame:
    return rows.withColumn("_chunk", F.coalesce(chunk.cast("bigint"), F.lit(_NO_CHUNK)))


def _join_chunks(rows: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on keys and chunk, the partitioning the window that follows needs as well: one
    shuffle moves the rows, whether AQE broadcasts the chunks or not."""
    return rows.join(chunks, [*keys, "_chunk"])


def _ranked(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column
) -> DataFrame:
    """Add ``_rank``, the 0-based position of a row in its key's order."""
    cut = _in_chunks(rows, chunk)
    sizes = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        _join_chunks(cut, starts, keys)
        .withColumn("_rank", F.col("_first") + F.row_number().over(inside) - 1)
        .drop("_chunk", "_first")
    )


def rolling(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    start: int,
    end: int,
    measures: Mapping[str, Column],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Aggregates over ``ROWS BETWEEN start AND end`` (both at most 0), counted in rows.

    ``chunk`` must grow with ``order`` and keep few rows together. Rows are numbered through chunk
    sizes, regrouped into blocks of equal size, and the last ``-start`` rows of a block also go to
    the next block, where they serve as history only.
    """
    reach = -start
    if not (start <= end <= 0 and reach <= block_rows):
        raise ValueError("need start <= end <= 0 and no more history than block_rows")
    block = F.floor(F.col("_rank") / block_rows)
    home = F.struct(block.alias("_block"), F.lit(True).alias("_home"))
    ahead = F.struct((block + 1).alias("_block"), F.lit(False).alias("_home"))
    near_end = F.col("_rank") % block_rows >= block_rows - reach
    spread = _ranked(rows, keys, order, chunk).select(
        "*", F.inline(F.when(near_end, F.array(home, ahead)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(start, end)
    measured = spread.select(
        *rows.columns, "_home", *[agg.over(frame).alias(name) for name, agg in measures.items()]
    )
    return measured.where("_home").drop("_home")


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    measures: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Aggregates over all rows up to the current one.

    ``measures`` maps an output name to (``sum`` | ``count`` | ``min`` | ``max``, column). Each
    chunk is summarised, the summaries of earlier chunks are combined (one row per chunk), and
    every row adds what its own chunk held so far.
    """
    cut = _in_chunks(rows, chunk)
    totals = cut.groupBy(*keys, "_chunk").agg(
        *[_MEASURE[kind](column).alias(f"_total_{name}") for name, (kind, column) in measures.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys,
        "_chunk",
        *[
            _COMBINE[kind](f"_total_{name}").over(earlier).alias(f"_carried_{name}")
            for name, (kind, _) in measures.items()
        ],
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _join_chunks(cut, carried, keys)
    own = joined.select(
        *rows.columns,
        *[f"_carried_{name}" for name in measures],
        *[
            _MEASURE[kind](column).over(inside).alias(f"_own_{name}")
            for name, (kind, column) in measures.items()
        ],
    )
    return own.select(*rows.columns, *[_combined(name, kind) for name, (kind, _) in measures.items()])


def _combined(name: str, kind: str) -> Column:
    carried, own = F.col(f"_carried_{name}"), F.col(f"_own_{name}")
    if kind == "min":
        value = F.least(carried, own)
    elif kind == "max":
        value = F.greatest(carried, own)
    else:
        value = F.coalesce(carried + own, own, carried)
        if kind == "sum":
            value = to_bigint(value)
    return value.alias(name)
