"""Shared helpers: stored tables, row identity, gapless numbers, texts as byte arrays."""

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder, remove_folder

# white space of the text contracts: space and \t \n \v \f \r
WHITE = b" \t\n\x0b\x0c\r"
# bytes of text that one step of a vectorised function takes at most (a longer text is one step)
STEP_BYTES = 1_000_000
# words of lower-cased texts: digits, letters a-z and characters beyond ASCII
ALNUM_WORD = rb"[0-9a-z\x80-\xff]+"
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
NO_ID = -(2**63)
CHUNK_ROWS = 100_000  # rows that are numbered in one place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a later failure redoes nothing before it."""
    return stored_at(df, purpose)[0]


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As :func:`stored`, with the folder, which the caller removes when it is done with the table."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Rounds:
    """Stored tables of an iteration: a table goes when the next one of its name is stored."""

    def __init__(self) -> None:
        self._paths: dict[str, str] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        table_, path = stored_at(df, name)
        before = self._paths.get(name)
        self._paths[name] = path
        if before is not None:
            remove_folder(df.sparkSession, before)
        return table_

    def keep(self, name: str) -> None:
        """Leave the present table of this name for good."""
        self._paths.pop(name, None)


def few_broadcast(rows: DataFrame, most: int) -> DataFrame:
    """A stored table, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(rows) if rows.count() <= most else rows


def doc_key() -> Column:
    """doc_id for joins; rows without one share a key below every other."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def text_key() -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def fold(number: int) -> Column:
    """Remainder of the checksum of doc_id, which decides about held-out rows."""
    return F.crc32(doc_id_text().cast("binary")) % number


def doc_id_text() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunks: int | None = None
) -> DataFrame:
    """Number the rows of each key without gaps from 0.

    Rows are dealt into ``chunks`` per key by a hash of ``order``, by default so many that a chunk has
    about CHUNK_ROWS rows even if all rows have one key; only the chunk sizes of a key meet in one place, so
    a key may hold any share of the rows. ``df`` is read several times: pass a stored table. Rows equal in
    ``order`` are numbered in any order.
    """
    if chunks is None:
        chunks = max(256, df.count() // CHUNK_ROWS)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    sizes = dealt.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        dealt.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_chunk", "_start", "_place")
    )


def steps(batches: Iterator[pa.RecordBatch], size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each, none of them empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        step = (np.cumsum(sizes) - sizes) // size
        cuts = np.flatnonzero(np.diff(step)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the row limits within them; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    limits = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[limits[0] : limits[-1]], limits - limits[0]


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as bytes; a null is empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def lower_ascii(text: bytes) -> bytes:
    """The text with A-Z lower-cased and nothing else."""
    return text.translate(_LOWER)


def word_chunks(text: bytes, words: re.Pattern, size: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """Words of a lower-cased text in order, those of about ``size`` bytes of text at a time."""
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + size) if at + size < len(text) else None
        stop = end.start() if end else len(text)
        yield words.findall(text, at, stop)
        at = stop
