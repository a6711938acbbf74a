"""Importance resampling towards a target distribution, drawn by distributed quickselect.

1. Features of a text are its words and its pairs of neighbouring words, hashed into buckets by crc32.
   Each distinct word is hashed once while a worker remembers it; the checksum of a pair is put together
   from those of its words (a checksum carried over n more bytes is a linear map, kept as a table for
   every n), so all pairs of a step are hashed by a few array look-ups.
2. Each task adds its buckets up in one array; Spark adds the arrays of corpus and target. Both sums
   have a fixed size, whatever the corpus holds, and give every bucket a gain.
3. A second reading of the texts adds gains up: a document's weight is the mean over its features. With
   Gumbel noise from a hash of its doc_id, the k highest scores are a draw without replacement.
4. The k-th highest score is found by quickselect over the stored scores: some random keys of the
   range still open are pivots, one aggregation counts the rows below, at and between them, and the part
   that holds the k-th key is the next range. Keys are whole (score, doc_id, row), so every count is exact
   and the k-th key unique. Only the winners are then sorted and ranked, in ranges of bounded size.

Defined cases: null and empty texts have no features and weight 0; rows without doc_id hash an empty
one and come before others of the same score; rows that are alike in score and doc_id, repeated ones
too, are drawn in any order; an empty target or corpus leaves all gains defined; an empty table has no
rows; a long text is cut into words piece by piece and counted as a whole; columns other than doc_id and
text are not looked at.
"""

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORD, byte_texts, doc_id_text, doc_key, lower_ascii, steps, stored, table, word_chunks
from .encoders import MEMO_WORDS

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
PIVOTS = 32
RANGE_ROWS = 200_000  # winners that are ranked in one task
_WORD = re.compile(ALNUM_WORD)
_LONGEST = 64  # bytes of a word up to which a table carries checksums over it
_FLUSH = 100_000  # words that are hashed together
_POLYNOMIAL = 0xEDB88320


def carry_tables(longest: int) -> np.ndarray:
    """tables[n][k][b]: the checksum b << 8k carried over n more bytes (less what these add)."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(_POLYNOMIAL), byte >> 1)
    values = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [values]
    for _ in range(longest):
        values = (values >> 8) ^ byte[values & 255]
        out.append(values)
    return np.array(out)


class FeatureHasher:
    """Buckets of the words and word pairs of texts."""

    def __init__(self, buckets: int = BUCKETS, memory: int = MEMO_WORDS):
        self.buckets = buckets
        self.memory = memory
        self.tables = carry_tables(_LONGEST + 1)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.known = np.zeros((1024, 3), np.uint32)  # checksums of word and space + word, length of these

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.memory:
            self._forget()
        new = [w for w in set(words) if w not in self.index]
        count = len(self.index)
        if count + len(new) > len(self.known):
            more = np.zeros((2 * (count + len(new)), 3), np.uint32)
            more[:count] = self.known[:count]
            self.known = more
        self.index.update(zip(new, range(count, count + len(new))))
        for at, word in enumerate(new, count):
            self.known[at] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        return self.known[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def _pairs(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Checksums of the pairs of words with the given checksums."""
        sizes = after[:, 2]
        carried = np.zeros(len(first), np.uint32)
        short = np.minimum(sizes, _LONGEST + 1)
        for k in range(4):
            carried ^= self.tables[short, k, (first[:, 0] >> np.uint32(8 * k)) & 255]
        for at in np.flatnonzero(sizes > _LONGEST + 1).tolist():
            value = int(first[at, 0])
            # over the rest of a longer word, as many bytes a time as the tables have
            left = int(sizes[at])
            while left:
                step = min(left, _LONGEST + 1)
                value = int(np.bitwise_xor.reduce([self.tables[step, k, value >> 8 * k & 255] for k in range(4)]))
                left -= step
            carried[at] = value
        return carried ^ after[:, 1]

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words, buckets of the pair that each word begins, words of each text.

        The last word of a text begins no pair and has the bucket -1 there.
        """
        parts, pending, counts = [], [], []
        for text in texts:
            count = 0
            for words in word_chunks(lower_ascii(text), _WORD):
                count += len(words)
                pending += words
                if len(pending) >= _FLUSH:
                    parts.append(self._look_up(pending))
                    pending = []
            counts.append(count)
        parts.append(self._look_up(pending))
        found = np.concatenate(parts)
        ends = np.cumsum(np.array(counts, np.int64))
        pairs = np.full(len(found), -1, np.int64)
        if len(found):
            pairs[:-1] = self._pairs(found[:-1], found[1:]) % np.uint32(self.buckets)
            pairs[ends[ends > 0] - 1] = -1
        return (found[:, 0] % np.uint32(self.buckets)).astype(np.int64), pairs, np.array(counts, np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and count of the features of all texts; at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = FeatureHasher(buckets)
        total = np.zeros(buckets, np.int64)
        for batch in steps(batches):
            words, pairs, _ = hasher.features(byte_texts(batch.column("text")))
            total += np.bincount(words, minlength=buckets) + np.bincount(pairs[pairs >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "count"])

    counted = docs.select("text").mapInArrow(count, "bucket bigint, count bigint")
    return counted.groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Whole thousandths of the log ratio of both distributions, one added to every bucket."""

    def counts(docs: DataFrame) -> list[int]:
        found = [0] * buckets
        for bucket, count in bucket_counts(docs, buckets).collect():  # at most one row per bucket
            found[bucket] = count
        return found

    s, t = counts(corpus), counts(target)
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array(
        [math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t)], np.int64
    )


def feature_weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of the features, of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = FeatureHasher(len(gains))
        with_none = np.append(gains, 0)  # at -1: no pair
        for batch in steps(batches):
            words, pairs, counts = hasher.features(byte_texts(batch.column("text")))
            sums = np.concatenate([[0], np.cumsum(with_none[words] + with_none[pairs])])
            ends = np.cumsum(counts)
            features = np.maximum(2 * counts - 1, 0)
            weights = (sums[ends] - sums[ends - counts]) // np.maximum(features, 1)
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(features), pa.array(weights)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    schema = f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint"
    return docs.select("doc_id", "text").mapInArrow(weigh, schema)


def gumbel_noise(seed: int = SEED) -> Column:
    """Whole thousandths of a Gumbel variable that seed and doc_id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id_text()).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("bigint")


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(int(value)).cast("bigint").alias(f"k{i}") for i, value in enumerate(key)])


def kth_smallest(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th (from 1) smallest of the bigint tuples ``keys``, None where there are fewer rows.

    Every round takes ``pivots`` random keys of the open range and counts the rows at and between them,
    so that only these counts reach the driver. Ends as soon as a pivot is the k-th key: a round leaves one
    of ``pivots`` + 1 parts, and its pivots are never asked again.
    """
    key = F.struct(*[F.col(name).alias(f"k{i}") for i, name in enumerate(keys)])
    found = rows.select(key.alias("key"))
    low = high = None
    seed = 0
    while k > 0:
        open_range = F.lit(True)
        if low is not None:
            # the leading column alone is what the scan can skip by
            open_range = open_range & (F.col("key.k0") >= low[0]) & (F.col("key") > _literal(low))
        if high is not None:
            open_range = open_range & (F.col("key.k0") <= high[0]) & (F.col("key") < _literal(high))
        some = found.where(open_range)
        drawn = some.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(pivots).collect()
        chosen = sorted({tuple(row.key) for row in drawn})
        if not chosen:
            return None
        listed = F.array(*[_literal(c) for c in chosen])
        below = F.size(F.filter(listed, lambda p: p < F.col("key")))
        part = 2 * below + F.array_contains(listed, F.col("key")).cast("int")
        counts = dict(some.groupBy(part.alias("part")).count().collect())
        for number in range(2 * len(chosen) + 1):
            count = counts.get(number, 0)
            if k <= count:
                break
            k -= count
        else:
            return None
        if number % 2:
            return chosen[number // 2]
        low = chosen[number // 2 - 1] if number else low
        high = chosen[number // 2] if number < 2 * len(chosen) else high
        seed += 1
    return None


def ranked(rows: DataFrame, keys: list[str], count: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows``, about ``count`` of them, with their rank (from 1) by ``keys``, in ranges of bounded size."""
    ranges = rows.repartitionByRange(1 + count // range_rows, *keys)
    dealt = stored(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    numbered = dealt.withColumn("_place", place).join(starts, "_range")
    return numbered.withColumn("rank", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    pivots: int = PIVOTS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each row of ``docs``."""
    weights = feature_weights(docs, bucket_gains(docs, target, buckets))
    scored = weights.withColumn("score", F.col("weight") + gumbel_noise(seed)).withColumns(
        {"_low": -F.col("score"), "_doc": doc_key(), "_row": F.monotonically_increasing_id()}
    )
    scored = stored(scored, "scores")
    keys = ["_low", "_doc", "_row"]
    can_be_drawn = scored.where(F.col("n_words") >= least_words)
    count = can_be_drawn.count() * percent // 100
    last = kth_smallest(can_be_drawn, keys, count, pivots)
    none = F.lit(None).cast("bigint")
    if last is None:
        return scored.withColumn("rank", none).drop(*keys)
    drawn = (F.col("n_words") >= least_words) & (F.struct(*keys) <= F.struct(*[F.lit(v).cast("bigint") for v in last]))
    winners = ranked(scored.where(drawn & (F.col("_low") <= last[0])), keys, count, range_rows)
    return winners.unionByName(scored.where(~drawn).withColumn("rank", none)).drop(*keys)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


# crc32 of a text in SQL: its table by rule, then one step a byte
CRC_TABLE = """crc_steps(byte, step, value) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END
  FROM crc_steps WHERE step < 8
), crc_table AS (SELECT list(value ORDER BY byte) AS crc FROM crc_steps WHERE step = 8)"""


def crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of an expression; ``crc`` has to come from crc_table."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""


RESAMPLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), word_lists AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), features AS (
  SELECT side, doc_id, unnest(words) AS feature FROM word_lists
  UNION ALL
  SELECT side, doc_id, words[i] || ' ' || words[i + 1]
  FROM word_lists, unnest(range(1, greatest(len(words), 1))) AS r(i)
), hashed AS MATERIALIZED (
  SELECT feature, {crc_sql("feature")} % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM features), crc_table
), counted AS (
  SELECT side, doc_id, bucket, count(*) AS n FROM features JOIN hashed USING (feature) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t
  FROM counted GROUP BY bucket
), totals AS (SELECT sum(s)::BIGINT + 10000 AS all_s, sum(t)::BIGINT + 10000 AS all_t FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * all_s)::DOUBLE / ((s + 1) * all_t)::DOUBLE))::BIGINT AS gain
  FROM sums, totals
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scores AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM word_lists LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM places) // 100 THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)
"""
