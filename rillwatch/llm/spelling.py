"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each points to.

1. Words are counted task by task and summed by Spark; only words that occur often enough go on.
2. All words agree on one order of bigrams, the rarest first. A word's prefix is its three rarest bigrams
   (with all places of the last of them). Its pivots are two bigrams of the prefix that share no
   character, chosen by dynamic programming for the smallest sum of frequencies. One edit leaves one of
   two disjoint bigrams as it is, so of two near words the one whose prefix ends earlier in the order has
   a pivot in the other's prefix.
3. Pivots are joined with prefixes under position limits. An edit to the right of the common bigram leaves
   everything up to it in place, counted from the left; one to its left everything from it on, counted
   from the right. Of the other side, the half without the edit is the same too. So a join key is: place
   of the bigram, length of the pivot's word, and hashes of the two parts of the word that agree. A prefix
   word posts its keys for the three lengths that its neighbours can have.
4. Tasks stream their sorted postings and verify all pairs of a key together: common start and end of two
   words have to cover all but one character. A key with more postings than a block is cut into tiles of
   two blocks each, which go to tasks of their own; nothing is capped.
5. Each word counts its near words and takes the most frequent as its form if that is frequent enough.
   Roots are found by pointer jumping, doubling the way in each stored round.

Words are runs of the letters a-z (A-Z lower-cased) and U+00C0 to U+00FF, so one byte of Latin-1 holds one
code point. One in 31 pairs of document and word loses one code point, which the checksum of both decides.

Defined cases: null and empty texts have no words; rows without doc_id hash an empty one; repeated rows
count each; words of any length are compared; of near words alike in frequency the smallest in code-point
order is the form; an empty table has no rows; a long text is cut into words piece by piece; columns other
than doc_id and text are not looked at.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, doc_id_text, lower_ascii, steps, stored, table
from .resampling import CRC_TABLE, crc_sql

DAMAGE = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_TIMES = 10
PREFIX = 3  # bigrams times edits plus one
BLOCK = 2048  # postings of a key that are verified together
TASK_WORDS = 300_000  # words that a task counts before it hands them on
_PAIRS = 400_000  # candidate pairs of one vectorised step
_WIDE = 48  # longer words are compared one by one
_LETTERS = rb"[a-z\xc0-\xff]"
_GAP = re.compile(rb"[^a-z\xc0-\xff]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


# ---------------------------------------------------------------- words


def letter_runs(text: str, pattern: re.Pattern, size: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """Runs of letters as Latin-1, those of about ``size`` characters at a time."""
    data = lower_ascii(text.encode("latin-1", "replace"))
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if at + size < len(data) else None
        stop = gap.start() if gap else len(data)
        yield pattern.findall(data, at, stop)
        at = stop


def damaged(begun: int, run: bytes, every: int = DAMAGE) -> bytes:
    """The run, without one of its code points where the checksum of document (``begun``) and run is divisible."""
    value = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
    if value % every:
        return run
    at = value % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DAMAGE
) -> DataFrame:
    """word and n: the words that are long enough, with their occurrences in all texts."""
    pattern = re.compile(_LETTERS + b"{%d,}" % least_length)

    def rows(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in steps(batches):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                begun = zlib.crc32(f"{doc}:".encode())
                for runs in letter_runs(text or "", pattern):
                    for run, times in Counter(runs).items():
                        word = damaged(begun, run, every)
                        if len(word) >= least_length:
                            counts[word] += times
                    if len(counts) > TASK_WORDS:
                        yield rows(counts)
                        counts = Counter()
        yield rows(counts)

    counted = docs.select(doc_id_text().alias("doc"), "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of each length, and their characters as a matrix."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(some):
            joined = b"".join(words[i] for i in some)
            yield some, np.frombuffer(joined, np.uint8).reshape(len(some), -1)


def _bigrams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def bigram_frequencies(words: DataFrame) -> np.ndarray:
    """Places in words of each of the 65536 bigrams; the letters allow 8,100 of them at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for _, letters in _by_length(_latin(batch.column("word"))):
                total += np.bincount(_bigrams(letters).ravel(), minlength=65536)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["gram", "places"])

    counted = words.select("word").mapInArrow(count, "gram bigint, places bigint")
    out = np.zeros(65536, np.int64)
    for gram, places in counted.groupBy("gram").agg(F.sum("places")).collect():
        out[gram] = places
    return out


# ---------------------------------------------------------------- postings


def prefix_places(ranks: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """Which bigrams of each word are among its ``length`` first in the order, the last with all its places."""
    last = np.partition(ranks, min(length, ranks.shape[1]) - 1, axis=1)[:, min(length, ranks.shape[1]) - 1]
    return ranks <= last[:, None]


def pivot_places(costs: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Two places of each word's prefix at least two apart, with the smallest sum of costs."""
    rows = np.arange(len(costs))
    none = np.iinfo(np.int64).max // 4
    costs = np.where(prefix, costs, none)
    best = np.full(len(costs), 2 * none)
    chosen = np.zeros((len(costs), 2), np.int64)
    first, first_at = np.full(len(costs), none), np.zeros(len(costs), np.int64)
    for place in range(2, costs.shape[1]):
        # the cheapest bigram that ends before this one begins
        earlier = costs[:, place - 2]
        first_at = np.where(earlier < first, place - 2, first_at)
        first = np.minimum(first, earlier)
        total = first + costs[:, place]
        better = rows[total < best]
        chosen[better, 0], chosen[better, 1] = first_at[better], place
        best = np.minimum(best, total)
    return chosen


class PartHashes:
    """Hashes of all starts and all ends of words of one length."""

    def __init__(self, letters: np.ndarray):
        count, self.length = letters.shape
        codes = _mixed(letters.astype(np.uint64) + _ODD)
        powers = np.cumprod(np.full(self.length, _ODD, np.uint64))
        self.starts = np.zeros((count, self.length + 1), np.uint64)
        self.ends = np.zeros((count, self.length + 1), np.uint64)
        np.cumsum(codes * powers, axis=1, out=self.starts[:, 1:])
        np.cumsum(codes[:, ::-1] * powers, axis=1, out=self.ends[:, 1:])

    def keys(self, word: np.ndarray, place: np.ndarray, target: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word numbers and keys of the bigram at ``place`` for a pivot's word of length ``target``."""
        # an edit to the right: the bigram has the same place from the left
        rest = target - place - 2
        half = rest // 2
        yield self._keys(1, word, place, target, place + 2 + half, 0 * place, rest >= 0)
        yield self._keys(2, word, place, target, place + 2, rest - half, half >= 1)
        # an edit to the left: the same from the right
        place = place + target - self.length
        half = place // 2
        yield self._keys(3, word, place, target, half, target - place, place >= 0)
        yield self._keys(4, word, place, target, 0 * place, target - half, half >= 1)

    def _keys(self, kind, word, place, target, start, end, allowed):
        keep = allowed & (start + end <= self.length)
        word, place, start, end = word[keep], place[keep], start[keep], end[keep]
        tag = (place.astype(np.uint64) * np.uint64(8) + np.uint64(kind)) * np.uint64(1 << 24) + np.uint64(target)
        key = _mixed(self.starts[word, start] + _mixed(self.ends[word, end] + _mixed(tag)))
        return word, key.view(np.int64)


def postings(words: DataFrame, frequencies: np.ndarray, least_length: int = LEAST_LENGTH) -> DataFrame:
    """key, pivot, word and n: keys of the pivots and of the prefix bigrams of every word."""
    ranks = np.empty(65536, np.int64)
    ranks[np.lexsort((np.arange(65536), frequencies))] = np.arange(65536)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                found: list[tuple[np.ndarray, np.ndarray, bool]] = []
                for rows, letters in _by_length(_latin(batch.column("word"))):
                    grams, parts = _bigrams(letters), PartHashes(letters)
                    prefix = prefix_places(ranks[grams])
                    pivots = pivot_places(frequencies[grams], prefix)
                    length = letters.shape[1]
                    for at in (0, 1):
                        for word, keys in parts.keys(np.arange(len(rows)), pivots[:, at], length):
                            found.append((rows[word], keys, True))
                    words_, places = np.nonzero(prefix)
                    for target in range(max(least_length, length - 1), length + 2):
                        for word, keys in parts.keys(words_, places, target):
                            found.append((rows[word], keys, False))
                word = pa.array(np.concatenate([f[0] for f in found]))
                pivot = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
                columns = [
                    pa.array(np.concatenate([f[1] for f in found])),
                    pa.array(pivot),
                    batch.column("word").take(word),
                    batch.column("n").take(word),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "pivot", "word", "n"])

    return words.select("word", "n").mapInArrow(post, "key bigint, pivot boolean, word string, n bigint")


# ---------------------------------------------------------------- pairs


def one_edit_apart(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[start + 1 :] == b[start + 1 :] if len(a) == len(b) else a[start:] == b[start + 1 :]


class _Words:
    """Words in matrices, aligned left and right, to compare many pairs at a time."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.array([len(w) for w in words], np.int64)
        width = int(min(_WIDE, self.sizes.max(initial=1)))
        self.left = np.zeros((len(words), width), np.uint8)
        self.right = np.zeros((len(words), width), np.uint8)
        joined = np.frombuffer(b"".join(w[:width] for w in words), np.uint8)
        row = np.repeat(np.arange(len(words)), np.minimum(self.sizes, width))
        first = np.cumsum(np.minimum(self.sizes, width)) - np.minimum(self.sizes, width)
        place = np.arange(len(joined)) - first[row]
        self.left[row, place] = joined
        self.right[row, (self.sizes[row] - 1 - place) % width] = joined

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are exactly one edit apart."""
        out = np.abs(self.sizes[a] - self.sizes[b]) <= 1
        longer = np.maximum(self.sizes[a], self.sizes[b])
        for at in np.flatnonzero(out & (longer > _WIDE)).tolist():
            out[at] = one_edit_apart(self.words[a[at]], self.words[b[at]])
        some = np.flatnonzero(out & (longer <= _WIDE))
        x, y, size = a[some], b[some], longer[some]
        shared = np.zeros(len(some), np.int64)
        equal = np.ones(len(some), bool)
        for matrix in (self.left, self.right):
            differ = matrix[x] != matrix[y]
            any_ = differ.any(1)
            equal &= ~any_
            shared += np.where(any_, differ.argmax(1), matrix.shape[1])
        out[some] = ~equal & (shared >= size - 1)
        return out


_FOUND = "a string, na bigint, b string, nb bigint, key bigint, pivot boolean, block bigint"
_NAMES = ["a", "na", "b", "nb", "key", "pivot", "block"]


def _near_pairs(block: int):
    """Sorted postings to near pairs (b is set), or to numbered blocks of a key with too many (b is null)."""

    def left_over(rows: pa.Table, first: int = 0) -> pa.RecordBatch:
        number = (np.arange(rows.num_rows) + first) // block
        none = pa.nulls(rows.num_rows, pa.string()), pa.nulls(rows.num_rows, pa.int64())
        columns = [rows["word"], rows["n"], *none, rows["key"], rows["pivot"], pa.array(number)]
        return pa.table(columns, _NAMES).combine_chunks().to_batches()[0]

    def verified(rows: pa.Table, begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        pivot = rows["pivot"].to_numpy()
        firsts = np.concatenate([[0], np.cumsum(pivot)])
        pivots = firsts[ends] - firsts[begins]
        others = ends - begins - pivots
        both = (pivots > 0) & (others > 0)
        begins, ends, pivots, others = begins[both], ends[both], pivots[both], others[both]
        if not len(begins):
            return
        # of each key the other postings come first, then the pivots: one piece of pairs per pivot
        run = np.repeat(np.arange(len(begins)), pivots)
        row = np.arange(len(run)) - (np.cumsum(pivots) - pivots)[run] + (begins + others)[run]
        partners = others[run]
        # only the words of such keys are looked at
        used = np.zeros(rows.num_rows, bool)
        marks = np.zeros(rows.num_rows + 1, np.int64)
        np.add.at(marks, begins, 1)
        np.add.at(marks, ends, -1)
        used[:] = np.cumsum(marks)[:-1] > 0
        new = np.cumsum(used) - 1
        kept = rows.filter(pa.array(used))
        texts, n = _latin(kept["word"]), kept["n"].to_numpy()
        words = _Words(texts)
        step = (np.cumsum(partners) - 1) // _PAIRS
        for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(step)) + 1):
            count = partners[cut]
            a = np.repeat(row[cut], count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[run[cut]], count)
            a, b = new[a], new[b]
            near = words.near(a, b)
            pairs = {
                ((texts[x], int(n[x])), (texts[y], int(n[y])))
                if texts[x] < texts[y]
                else ((texts[y], int(n[y])), (texts[x], int(n[x])))
                for x, y in zip(a[near].tolist(), b[near].tolist())
            }
            listed = sorted(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0][0].decode("latin-1") for p in listed], pa.string()),
                    pa.array([p[0][1] for p in listed], pa.int64()),
                    pa.array([p[1][0].decode("latin-1") for p in listed], pa.string()),
                    pa.array([p[1][1] for p in listed], pa.int64()),
                    pa.nulls(len(listed), pa.int64()),
                    pa.nulls(len(listed), pa.bool_()),
                    pa.nulls(len(listed), pa.int64()),
                ],
                _NAMES,
            )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the key at the end of what was read, while it may be short
        long_key, long_rows = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            keys = rows["key"].to_numpy()
            if long_key is not None and len(keys):
                same = int(np.searchsorted(keys, long_key, "right"))
                if same:
                    yield left_over(rows.slice(0, same), long_rows)
                    long_rows += same
                    rows, keys = rows.slice(same), keys[same:]
            if not len(keys):
                held = None
                continue
            long_key = None
            limits = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            begins, ends = limits, np.append(limits[1:], len(keys))
            long = ends - begins > block
            for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
                yield left_over(rows.slice(begin, end - begin))
            short = ~long
            if long[-1]:
                long_key, long_rows, held = int(keys[-1]), int(ends[-1] - begins[-1]), None
            else:
                short[-1] = False
                held = rows.slice(int(begins[-1]))
            yield from verified(rows, begins[short], ends[short])
        if held is not None and held.num_rows:
            yield from verified(held, np.array([0]), np.array([held.num_rows]))

    return find


def near_words(
    words: DataFrame, frequencies: np.ndarray, least_length: int = LEAST_LENGTH, block: int = BLOCK
) -> DataFrame:
    """a, na, b and nb: all pairs of words exactly one edit apart, each once, with their occurrences."""

    def search(rows: DataFrame, size: int) -> DataFrame:
        dealt = rows.repartition("key").sortWithinPartitions("key", "pivot")
        return stored(dealt.mapInArrow(_near_pairs(size), _FOUND), "near-words")

    found = search(postings(words, frequencies, least_length), block)
    pairs = found.where(F.col("b").isNotNull())
    while not found.where(F.col("b").isNull()).isEmpty():
        left = found.where(F.col("b").isNull())
        blocks = left.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        tiles = left.join(blocks, "key").withColumn("other", other)
        tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        rows = tiles.select(tile.alias("key"), "pivot", F.col("a").alias("word"), F.col("na").alias("n"))
        # a tile holds two blocks
        block *= 2
        found = search(rows, block)
        pairs = pairs.unionByName(found.where(F.col("b").isNotNull()))
    return pairs.select("a", "na", "b", "nb").distinct()


# ---------------------------------------------------------------- forms


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of all words with a form: each round follows twice as many forms."""
    ways = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not ways.where("moved").isEmpty():
        on = ways.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        ahead = ways.join(on, F.col("root") == F.col("_at"), "left")
        moved = F.col("_on").isNotNull().alias("moved")
        ways = stored(ahead.select("word", F.coalesce("_on", "root").alias("root"), moved), "roots")
    return ways.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    times: int = FORM_TIMES,
    every: int = DAMAGE,
    block: int = BLOCK,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of all texts."""
    words = stored(word_counts(docs, least_length, least_count, every), "words")
    pairs = near_words(words, bigram_frequencies(words), least_length, block)
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")),
        )
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = (
        pairs.select(ends.alias("end"))
        .select("end.*")
        .groupBy("word", "n")
        .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    )
    has_form = -F.col("best.less") >= times * F.col("n")
    known = stored(
        near.select(
            "word",
            "n_near",
            F.when(has_form, F.col("best.near")).alias("form"),
            F.when(has_form, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(known.where(F.col("form").isNotNull()))
    return (
        words.join(known, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            "form_n",
        )
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc_sql("doc_id || ':' || run")} AS h FROM runs, crc_table
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n
    FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS MATERIALIZED (
  SELECT word, i, word[1:i] || word[i + 2:] AS rest FROM words, unnest(range(0, length(word))) AS r(i)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cuts.word, words.word FROM cuts JOIN words ON cuts.rest = words.word
  UNION SELECT words.word, cuts.word FROM cuts JOIN words ON cuts.rest = words.word
), best AS (
  SELECT near.word, count(*) AS n_near, first(b.word ORDER BY b.n DESC, b.word) AS top, max(b.n) AS top_n
  FROM near JOIN words b ON b.word = near.near GROUP BY near.word
), forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form,
    CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS at, form FROM forms
  UNION ALL
  SELECT ways.word, forms.word, forms.form FROM ways JOIN forms ON forms.word = ways.form
)
SELECT forms.word, forms.form, ways.at AS root, n, n_near, form_n
FROM forms JOIN ways ON ways.word = forms.word AND ways.form IS NULL
"""
