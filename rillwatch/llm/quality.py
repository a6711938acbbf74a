"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the whole texts gives each document a row of statistics, which is stored. Trees of fixed
depth are boosted on binned statistics of at most MAX_LABELLED labelled documents (chosen by a hash of
doc_id), each level from one histogram of gradients per node and bin. The finished trees are flat
arrays in heap order, so scoring walks all documents of a batch through a tree level by level in numpy.

Defined cases: null text counts as empty, and empty texts are scored like any other; rows without a
label or with a label other than 0 and 1 are not learned from; without any labels every score is 0.5;
several labels of one doc_id all count.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, doc_key, fold, steps, stored, table

THRESHOLD = 0.7
MAX_LABELLED = 50_000  # bound of the labelled sample that the trees are fitted on
TREES, DEPTH, BINS = 60, 4, 64
RATE, RIDGE, LEAST = 0.15, 1.0, 10.0

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "stop": b".!?",
    "comma": b",;:",
    "mark": b"#$%&*@^~_=+",
    "bar": b"|",
    "bracket": b"()[]{}<>",
    "quote": b"'\"`",
    "slash": b"/\\-",
}
STATISTICS = (
    "bytes", "words", "lines",
    *(f"share_{name}" for name in _CLASSES), "share_other",
    "mean_word", "longest_word", "distinct_words", "upper_words", "marked_words", "short_words",
    "mean_line", "distinct_lines", "empty_lines", "longest_line", "compression",
)
_LUT = bytes(
    next((n for n, members in enumerate(_CLASSES.values()) if byte in members), len(_CLASSES))
    for byte in range(256)
)
_MARKED = re.compile(rb"[#$%&*@!|]\s")


def text_statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    size = len(text)
    classes = np.bincount(np.frombuffer(text.translate(_LUT), np.uint8), minlength=len(_CLASSES) + 1)
    words = text.split()
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = set(words)
    shouted = sum(map(bytes.isupper, words))
    lines = text.split(b"\n")
    return [
        float(np.log1p(size)),
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        *(classes / max(1, size)),
        float(lengths.mean()) if len(words) else 0.0,
        float(lengths.max(initial=0)),
        len(distinct) / n_words,
        shouted / n_words,
        len(_MARKED.findall(text)) / n_words,
        float((lengths <= 3).sum()) / n_words,
        size / len(lines),
        len(set(lines)) / len(lines),
        lines.count(b"") / len(lines),
        float(max(map(len, lines))),
        len(zlib.compress(text, 1)) / max(1, size),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        rows = [text_statistics(t) for t in byte_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"]
        )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array of statistics of each whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_statistics, "doc_id bigint, stats array<double>")


class BoostedTrees:
    """Trees of one depth in heap order: ``feature`` and ``limit`` of inner nodes, ``leaf`` values.

    A row goes to the right child where its statistic exceeds the limit; a node that is not split has an
    infinite limit, and its rows all end in its leftmost leaf.
    """

    def __init__(self, start: float, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.limit, self.leaf = start, feature, limit, leaf

    @classmethod
    def fit(cls, data: np.ndarray, labels: np.ndarray) -> "BoostedTrees":
        rows, width = data.shape
        edges = [np.unique(np.quantile(data[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, data[:, j]) for j, e in enumerate(edges)], axis=1)
        share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
        start = float(np.log(share / (1 - share)))
        total = np.full(rows, start)
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        feature = np.zeros((TREES, inner), np.int64)
        limit = np.full((TREES, inner), np.inf)
        leaf = np.zeros((TREES, leaves))
        for tree in range(TREES):
            chance = 1 / (1 + np.exp(-total))
            gradient, weight = chance - labels, chance * (1 - chance)
            node = np.zeros(rows, np.int64)
            for depth in range(DEPTH):
                count, first = 2**depth, 2**depth - 1
                best = np.full(count, 1e-9)
                cut = np.full(count, -1)
                for j in range(width):
                    key = node * BINS + binned[:, j]
                    g = np.bincount(key, gradient, count * BINS).reshape(count, BINS).cumsum(1)
                    h = np.bincount(key, weight, count * BINS).reshape(count, BINS).cumsum(1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = (
                        g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                    )
                    gain[(h < LEAST * 0.1) | (h_all - h < LEAST * 0.1)] = 0
                    gain[:, len(edges[j]) :] = 0
                    at = gain.argmax(1)
                    found = gain[np.arange(count), at]
                    better = found > best
                    best[better], cut[better] = found[better], at[better]
                    feature[tree, first : first + count][better] = j
                for i in np.flatnonzero(cut >= 0):
                    limit[tree, first + i] = edges[feature[tree, first + i]][cut[i]]
                right = data[np.arange(rows), feature[tree, first + node]] > limit[tree, first + node]
                node = 2 * node + right
            g = np.bincount(node, gradient, leaves)
            h = np.bincount(node, weight, leaves)
            leaf[tree] = -RATE * g / (h + RIDGE)
            total += leaf[tree][node]
        return cls(start, feature, limit, leaf)

    def score(self, data: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(data), self.start)
        row = np.arange(len(data))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(data), np.int64)
            for depth in range(DEPTH):
                at = node + 2**depth - 1
                node = 2 * node + (data[row, feature[at]] > limit[at])
            total += leaf[node]
        return 1 / (1 + np.exp(-total))


def fit_quality(
    statistics: DataFrame, labels: DataFrame, learns: Column, bound: int = MAX_LABELLED
) -> BoostedTrees:
    """Trees learned from the labels of the documents for which ``learns`` (on doc_id) holds."""
    clean = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(
        F.col("quality").isin(0, 1) & learns
    )
    total = clean.count()
    draw = F.pmod(F.xxhash64(F.lit("draw"), doc_key()), F.lit(1_000_000))
    drawn = clean.where(draw < int(min(1.0, bound / max(1, total)) * 1_000_000))
    found = statistics.join(drawn, "doc_id").select("stats", "quality")
    # a doc_id that repeats in both tables has the product of its rows
    found = found.orderBy(F.xxhash64("stats", "quality")).limit(2 * bound).toArrow()
    if not found.num_rows:
        return BoostedTrees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    data = np.array(found["stats"].to_pylist())
    labels = found["quality"].to_numpy().astype(float)
    # one order whatever the tasks', so that sums of doubles come out alike
    order = np.lexsort([labels, *data.T])
    return BoostedTrees.fit(data[order], labels[order])


def quality_score(stats: Column, trees: BoostedTrees, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast((trees.start, trees.feature, trees.limit, trees.leaf))

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        data = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return pa.array(BoostedTrees(*shared.value).score(data))

    return scored(stats)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(4) == 2
    statistics = stored(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    trees = fit_quality(statistics, table(spark, sf_dir, "labels"), ~held_out)
    score = quality_score(F.col("stats"), trees, spark)
    return statistics.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
