"""Line dedup: keep bitmaps of documents whose repeated lines go.

Each line becomes a 128-bit hash with its document and position, never its text. The hashes are range
partitioned by (hash, document, position), so even one line held by a third of all documents spreads
over many tasks, and each task streams its sorted rows: the first document of a hash keeps it, later
ones drop it. A hash that reaches over a task's edge is settled by one row per task edge.

Defined cases: null or empty text is one empty line; rows without doc_id count as one document that
precedes all others; rows that share a doc_id are one document; repeated rows get equal bitmaps.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import with_once
from .common import WHITE, byte_texts, doc_key, stored, steps, table, text_key

_WORD = r"[^\x20\x09-\x0D]"
MIN_CHARS = 10
DROP, PENDING, EDGE = 0, 1, 2
_LINES = "h1 bigint, h2 bigint, doc bigint, text_hash bigint, pos int"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            digests, rows, places = [], [], []
            for row, text in enumerate(byte_texts(batch.column("text"))):
                for place, line in enumerate(text.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line_key(line)
                    # a code point has at most four bytes
                    if len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars:
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        rows.append(row)
                        places.append(place)
            if not rows:
                continue
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    batch.column("doc").take(at),
                    batch.column("text_hash").take(at),
                    pa.array(places, pa.int32()),
                ],
                ["h1", "h2", "doc", "text_hash", "pos"],
            )

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, document and position to rows that are dropped, pending or an edge.

    The first hash of a task may have begun in an earlier one: its rows stay pending. The edge rows
    tell the first document seen here for the task's first and last hash.
    """
    names = ["kind", "h1", "h2", "doc", "text_hash", "pos"]

    def made(kind, h1, h2, doc, text_hash, pos):
        columns = [np.full(len(doc), kind, np.int8), h1, h2, doc, text_hash, np.asarray(pos, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    head = None  # first hash of this task and its first document
    last = None  # hash and first document of the run that goes on
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, text_hash, pos = (batch.column(n).to_numpy(zero_copy_only=False) for n in names[1:])
        begins = np.ones(len(h1), bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None and (h1[0], h2[0]) == last[0]:
            begins[0] = False
        run = np.cumsum(begins)
        firsts = np.concatenate([[last[1] if last is not None else doc[0]], doc[begins]])
        first_doc = firsts[run]
        if head is None:
            head = ((h1[0], h2[0]), doc[0])
        pending = (h1 == head[0][0]) & (h2 == head[0][1])
        last = ((h1[-1], h2[-1]), first_doc[-1])
        for kind, chosen in ((PENDING, pending), (DROP, ~pending & (doc != first_doc))):
            if chosen.any():
                yield made(kind, h1[chosen], h2[chosen], doc[chosen], text_hash[chosen], pos[chosen])
    if head is not None:
        edges = [head, last]
        yield made(
            EDGE,
            np.array([e[0][0] for e in edges], np.int64),
            np.array([e[0][1] for e in edges], np.int64),
            np.array([e[1] for e in edges], np.int64),
            np.zeros(2, np.int64),
            np.zeros(2, np.int32),
        )


def kept_flags(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Flags of the lines of a document that stay."""
    flags = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        flags[: len(bits)] = bits
    return flags


def keep_bitmap(positions: list[int]) -> bytes:
    """Compressed bits, 1 where a line stays, in whole bytes up to the last dropped line.

    All lines behind the bitmap stay, and so the bits that fill its last byte are ones.
    """
    bits = np.ones(max(positions) // 8 * 8 + 8, np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("positions").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                batch.column("text_hash"),
                pa.array([len(set(p)) for p in lists], pa.int64()),
                pa.array([keep_bitmap(p) for p in lists], pa.binary()),
            ],
            ["doc", "text_hash", "n_dropped", "keep"],
        )


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document that loses lines: doc, text_hash, n_dropped and the compressed bitmap.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that occur in two documents or more stay only in the smallest doc_id.
    Documents without a row keep every line.
    """
    keyed = docs.select(doc_key().alias("doc"), text_key().alias("text_hash"), "text")
    hashes = keyed.mapInArrow(_line_hashes(min_chars), _LINES)
    order = ["h1", "h2", "doc", "pos"]
    ranged = hashes.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(
        ranged.mapInArrow(_first_occurrences, "kind tinyint, " + _LINES), "line-occurrences"
    )
    # two rows per task: their number is bounded by the number of partitions
    heads = (
        found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
    )
    where = ["doc", "text_hash", "pos"]
    sure = found.where(F.col("kind") == DROP).select(*where)
    settled = (
        found.where(F.col("kind") == PENDING)
        .join(F.broadcast(heads), ["h1", "h2"])
        .where(F.col("doc") > F.col("first_doc"))
        .select(*where)
    )
    positions = (
        sure.unionByName(settled)
        .groupBy("doc", "text_hash")
        .agg(F.collect_list("pos").alias("positions"))
    )
    return positions.mapInArrow(_bitmaps, "doc bigint, text_hash bigint, n_dropped bigint, keep binary")


def _keep_lines(text: pa.Array, keep: pa.Array) -> pa.Array:
    texts, counts, dropped = [], [], []
    for raw, bitmap in zip(byte_texts(text), keep.to_pylist()):
        lines = raw.split(b"\n")
        counts.append(len(lines))
        if bitmap is None:
            texts.append(raw)
            dropped.append(0)
        else:
            flags = kept_flags(bitmap, len(lines))
            texts.append(b"\n".join([line for line, stays in zip(lines, flags) if stays]))
            dropped.append(int(len(lines) - flags.sum()))
    return pa.StructArray.from_arrays(
        [
            pa.array(texts, pa.binary()).cast(pa.string()),
            pa.array(counts, pa.int64()),
            pa.array(dropped, pa.int64()),
        ],
        ["text", "n_lines", "n_dropped"],
    )


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows of ``docs`` as column ``row``, beside ``kept`` (text, n_lines, n_dropped)."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        doc_key().alias("doc"),
        text_key().alias("text_hash"),
    )
    joined = rows.join(bitmaps.select("doc", "text_hash", "keep"), ["doc", "text_hash"], "left")
    keep_lines = F.arrow_udf(_keep_lines, "struct<text: string, n_lines: bigint, n_dropped: bigint>")
    return joined.select("row", keep_lines(F.col("row.text"), F.col("keep")).alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with their repeated lines taken out of ``text``; null text becomes empty.

    ``n_chars``, where there is such a column, is counted anew. With ``drop_emptied`` documents that lost
    their last word go; those that never had one stay.
    """
    kept = apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_chars))
    if drop_emptied:
        # a filter on the function's result would cut the lines of every text a second time
        once = with_once(kept.select("row", F.col("kept").alias("_kept")), F.col("_kept").alias("kept"))
        before, after = F.coalesce("row.text", F.lit("")), F.col("kept.text")
        kept = once.where(~before.rlike(_WORD) | after.rlike(_WORD))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("kept.text").alias(name))
        elif name == "n_chars":
            columns.append(F.char_length("kept.text").cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return kept.select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_keep_bitmaps(docs, line_keep_bitmaps(docs))
    return kept.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("kept.n_lines").alias("n_lines"),
        F.col("kept.n_dropped").alias("n_dropped"),
        F.sha2(F.col("kept.text").cast("binary"), 256).alias("kept_sha256"),
    )
