"""N-gram Jaccard join: groups of documents whose sets of word shingles are similar enough.

1. Texts with equal sets form a class; only one document of a class goes on.
2. All documents agree on one order of shingles, those of crowded hash buckets last. Two sets that are
   similar enough share a shingle among their first few, so each set posts only these.
3. Postings are range partitioned by shingle, size and document. Each task streams its sorted postings
   and keeps the shared ones, with each document's neighbour in size. Neighbours are verified first:
   that already joins groups of near copies of any size, at one pair a document and not one a pair.
4. Lists that still hold different groups are cut into tiles of bounded size, sorted by size: pairs of
   different groups inside the size band are tested by their hashed bitmaps (every bit set in one and
   not in the other is a shingle the other lacks, which bounds the overlap from above) and, if they
   pass, by intersecting the sorted arrays. Nothing is capped: a long list has more tiles. Short lists
   are one tile, and their pairs are tested once each, not in every list that has them.

Words are runs of characters other than white space, A-Z lower-cased. A text with fewer words than a
shingle has its whole sequence as its one shingle.

Defined cases: null or empty texts and texts without words have an empty set and are linked with
nothing; rows that share a doc_id are one document, in one group, and link by any of their texts; rows
without doc_id are documents of their own, those of equal text together.
"""

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, WHITE, doc_key, raw_texts, steps, stored, table, text_key
from .components import connected_components

BUCKET_BITS = 20
LEAST_BITS, MOST_BITS = 512, 65536
TILE = 512
SHORT = 16  # pairs of lists up to this length are tested once a pair and not in every list
FIRSTS = 4
LONG, MOST_LONG = 24, 200_000  # postings with so many documents count as long; as many are remembered
BROADCAST_IDS = 200_000  # more ids of documents than this are joined by a shuffle
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts, all texts of a step together."""

    def __init__(self, size: int):
        self.size = size
        codes = np.arange(256, dtype=np.uint64)
        codes[65:91] += np.uint64(32)
        self.codes = _mixed(codes + np.uint64(_ODD))
        self.white = np.zeros(256, bool)
        self.white[list(WHITE)] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size + 1:
            self.powers = np.full(size + 1, _ODD, np.uint64)
            self.inverse = np.full(size + 1, pow(_ODD, -1, 1 << 64), np.uint64)
            self.powers[0] = self.inverse[0] = 1
            self.powers, self.inverse = np.cumprod(self.powers), np.cumprod(self.inverse)

    def _words(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word and the number of the text it lies in."""
        ink = ~self.white[data]
        first = np.zeros(len(data) + 1, bool)
        first[limits] = True
        begins, ends = ink.copy(), ink.copy()
        begins[1:] &= ~ink[:-1] | first[1:-1]
        ends[:-1] &= ~ink[1:] | first[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self._grow(len(data))
        # a polynomial over the joined texts; a word's part of it, shifted to place 0, is its hash
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=sums[1:])
        hashes = (sums[end] - sums[start]) * self.inverse[start]
        return _mixed(hashes + (end - start).astype(np.uint64)), np.searchsorted(limits, start, "right") - 1

    def sets(self, data: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
        texts = len(limits) - 1
        if not len(data):
            return [np.zeros(0, np.uint64)] * texts
        words, owner = self._words(data, limits)
        counts = np.bincount(owner, minlength=texts)
        ends = np.cumsum(counts)
        total = np.zeros(max(0, len(words) - self.size + 1), np.uint64)
        for place in range(self.size):
            total = total * np.uint64(_ODD) + words[place : place + len(total)]
        total = _mixed(total)
        out = []
        for begin, end in zip(ends - counts, ends):
            if end - begin >= self.size:
                out.append(np.unique(total[begin : end - self.size + 1]))
            elif end > begin:
                whole = 0
                for word in words[begin:end].tolist():
                    whole = (whole * _ODD + word) & _MASK
                out.append(_mixed(np.array([whole ^ int(end - begin)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _sets(size: int, batches: Iterator[pa.RecordBatch]):
    shingler = Shingler(size)
    for batch in steps(batches):
        yield batch, shingler.sets(*raw_texts(batch.column("text")))


def _crowded_buckets(size: int):
    """Buckets that hold far more shingles than the mean of a task's buckets, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for _, sets in _sets(size, batches):
            found = np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)
            counts += np.bincount(found.astype(np.int64), minlength=len(counts))
        usual = counts.mean()
        crowded = np.flatnonzero(counts >= usual + 4 * np.sqrt(usual) + 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(crowded, pa.int32()), pa.array(counts[crowded])], ["bucket", "n"]
        )

    return run


def _bitmap(hashes: np.ndarray) -> bytes:
    """Bits of the hashes, at least four bits a shingle up to MOST_BITS: a power of two of them."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(hashes) - 1).bit_length())) if len(hashes) else LEAST_BITS
    bits = np.zeros(size, np.uint8)
    bits[(hashes % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class Bitmaps:
    """Bitmaps of several lengths, those of one length as the rows of a matrix."""

    def __init__(self, raw: list[bytes]):
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.rows = {}
        for size in np.unique(self.sizes):
            at = np.flatnonzero(self.sizes == size)
            self.place[at] = np.arange(len(at))
            self.rows[size] = np.frombuffer(b"".join([raw[i] for i in at]), np.uint64).reshape(len(at), -1)

    def _taken(self, size: int, at: np.ndarray, to: int) -> np.ndarray:
        """Rows, folded to the length ``to``: a shorter bitmap is a longer one's parts together."""
        rows = self.rows[size][self.place[at]]
        return rows if size == to else np.bitwise_or.reduce(rows.reshape(len(at), size // to, -1), axis=1)

    def bound(self, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most shingles that the sets ``a`` and ``b`` (of ``n`` shingles each) can share."""
        out = np.empty(len(a), np.int64)
        combined = self.sizes[a] << 32 | self.sizes[b]
        for both in np.unique(combined):
            chosen = np.flatnonzero(combined == both)
            left, right = int(both) >> 32, int(both) & 0xFFFFFFFF
            for start in range(0, len(chosen), 2048):
                some = chosen[start : start + 2048]
                x = self._taken(left, a[some], min(left, right))
                y = self._taken(right, b[some], min(left, right))
                only_x = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
                only_y = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
                out[some] = np.minimum(n[a[some]] - only_x, n[b[some]] - only_y)
        return out


def least_overlap(size: int, num: int, den: int) -> int:
    """Shingles that a set of this size shares with any set that is similar enough."""
    return -(-size * num // den)


def _prefixes(size: int, num: int, den: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, crowds, tokens, lengths = order.value
        weight = np.zeros(1 << BUCKET_BITS, np.int64)
        weight[buckets] = crowds
        for batch, sets in _sets(size, batches):
            digests, prefixes, bitmaps = [], [], []
            for found in sets:
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                first = len(found) - least_overlap(len(found), num, den) + 1 if len(found) else 0
                crowd = weight[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                if len(tokens) and len(found):
                    at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                    crowd = np.where(tokens[at] == found, lengths[at], crowd)
                # hashes are sorted, so a stable sort by crowd orders by (crowd, hash)
                prefixes.append(found[np.argsort(crowd, kind="stable")[:first]].astype(np.int64))
                bitmaps.append(_bitmap(found))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            limits = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("doc"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(np.concatenate(prefixes))),
                    pa.array(bitmaps, pa.binary()),
                ],
                ["doc_id", "doc", "n", "d1", "d2", "prefix", "bitmap"],
            )

    return run


def _shared_postings(num: int, den: int):
    """Postings sorted by shingle, size and document to those of shared shingles.

    ``before`` is the document before in the list, if its size is inside the band; ``near`` says that
    the document before or behind is. Lists at a task's edge may go on in another task: their rows are
    kept as near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        head = True

        def emit(token, n, node, first, last):
            same = token[1:] == token[:-1]
            shared = np.zeros(len(token), bool)
            shared[1:] |= same
            shared[:-1] |= same
            close = same & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num) & (node[1:] != node[:-1])
            near = np.zeros(len(token), bool)
            near[1:] |= close
            near[:-1] |= close
            for edge, on in ((0, first), (-1, last)):
                if on:
                    run_ = token == token[edge]
                    shared |= run_
                    near |= run_
            before = np.zeros(len(token), np.int64)
            before[1:] = node[:-1]
            has = np.zeros(len(token), bool)
            has[1:] = close
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(token[shared]),
                    pa.array(n[shared], pa.int32()),
                    pa.array(node[shared]),
                    pa.array(before[shared], mask=~has[shared]),
                    pa.array(near[shared]),
                ],
                ["token", "n", "node", "before", "near"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("token", "n", "node")]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            # the last list may go on in the next batch: of a long one, its last row is enough to go on
            begin = int(np.searchsorted(columns[0], columns[0][-1]))
            if begin:
                yield emit(*[c[:begin] for c in columns], head, False)
                head = False
            held = [c[begin:] for c in columns]
        if held is not None:
            yield emit(*held, head, True)

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for row in range(batch.num_rows):
                a, b = left[row].values.to_numpy(), right[row].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    return run


def _arrays(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(size, batches):
            limits = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = pa.array(np.concatenate(sets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), values)],
                ["node", "hashes"],
            )

    return run


def _tile_pairs(num: int, den: int, bitmaps: bool):
    """Rows sorted by tile and size to pairs of different groups that may be similar enough.

    A pair that shares several shingles is made in one list if one of them is among the smallest of both.
    """
    rest = [] if bitmaps else [None]

    def elsewhere(token, firsts, a, b):
        """Whether two rows share another of their smallest tokens: that list has the pair."""
        same = firsts[a][:, :, None] == firsts[b][:, None, :]
        at = same.any(2)
        first = firsts[a, at.argmax(1)]
        return at.any(1) & (first != token[a])

    def pairs(token, i, j, n, node, group, side, firsts, bits):
        # rows of a tile lie together; row r is compared with row r + k for k = 1, 2, ... while the
        # tile and the size band last
        found_a, found_b = [], []
        tile = np.ones(len(token), bool)
        tile[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        number = np.cumsum(tile)
        row, k = np.arange(len(token)), 0
        maps = Bitmaps(bits.tolist()) if bits is not None else None
        while len(row):
            k += 1
            row = row[row + k < len(token)]
            other = row + k
            on = (number[row] == number[other]) & (n[row] * den >= n[other] * num)
            row = row[on]
            other = row + k
            test = (group[row] != group[other]) & ((i[row] == j[row]) | (side[row] != side[other]))
            a, b = row[test], other[test]
            fresh = ~elsewhere(token, firsts, a, b)
            a, b = a[fresh], b[fresh]
            if maps is not None and len(a):
                good = maps.bound(n, a, b) * (num + den) >= num * (n[a] + n[b])
                a, b = a[good], b[good]
            found_a.append(node[a])
            found_b.append(node[b])
        a, b = np.concatenate([*found_a, node[:0]]), np.concatenate([*found_b, node[:0]])
        if not len(a):
            return None
        some = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(some[0]), pa.array(some[1])], ["a", "b"])

    names = ("token", "i", "j", "n", "node", "group", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            firsts = batch.column("firsts").flatten().to_numpy(zero_copy_only=False)
            columns.append(firsts.reshape(batch.num_rows, FIRSTS))
            if bitmaps:
                columns.append(np.array([*batch.column("bitmap").to_pylist(), None], object)[:-1])
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            token, i, j = columns[:3]
            ahead = (token != token[-1]) | (i != i[-1]) | (j != j[-1])
            begin = int(np.flatnonzero(ahead)[-1]) + 1 if ahead.any() else 0
            made = pairs(*[c[:begin] for c in columns], *rest) if begin else None
            if made is not None:
                yield made
            held = [c[begin:] for c in columns]
        made = pairs(*held, *rest) if held is not None else None
        if made is not None:
            yield made

    return run


def _few_broadcast(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _links(pairs: DataFrame, rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs whose sets are similar enough; the sets of these documents are read from their texts."""
    pairs = stored(pairs, "candidate-pairs")
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "candidates")
    wanted = rows.join(_few_broadcast(nodes), "doc", "left_semi").select("doc", "text")
    arrays = stored(wanted.mapInArrow(_arrays(size), "node bigint, hashes array<bigint>"), "shingle-arrays")
    left = arrays.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = arrays.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(_verify(num, den), "a bigint, b bigint")


def _bitmap_filter(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose bitmaps leave room for enough common shingles."""
    left = bitmaps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("bits_a"))
    right = bitmaps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("bits_b"))
    joined = pairs.join(left, "a").join(right, "b")

    @F.arrow_udf("boolean")
    def possible(n_a: pa.Array, bits_a: pa.Array, n_b: pa.Array, bits_b: pa.Array) -> pa.Array:
        n = np.concatenate([n_a.to_numpy(), n_b.to_numpy()]).astype(np.int64)
        maps = Bitmaps(bits_a.to_pylist() + bits_b.to_pylist())
        at = np.arange(len(n_a))
        bound = maps.bound(n, at, at + len(at))
        return pa.array(bound * (num + den) >= num * (n[at] + n[at + len(at)]))

    return joined.where(possible("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")


def _marks() -> list[Column]:
    """What tells apart the rows that repeat a doc_id or lack one."""
    return [
        doc_key().alias("doc"),
        F.col("doc_id").isNull().alias("lacks"),
        text_key().alias("h1"),
        F.xxhash64(F.lit("key"), F.col("text")).alias("h2"),
    ]


def _odd_keys(docs: DataFrame) -> DataFrame | None:
    """The marks of rows that repeat a doc_id or lack one, and a key of their own; None without such rows.

    The keys are hashes, drawn again until they differ from each other and from every doc_id.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("key"))
    counted = ids.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    odd_ids = stored(counted.where("key IS NULL OR n > 1").select(F.col("key").alias("doc")), "odd-ids")
    if odd_ids.isEmpty():
        return None
    marked = docs.select(*_marks())
    repeated = marked.where("NOT lacks").join(_few_broadcast(odd_ids.where("doc IS NOT NULL")), "doc", "left_semi")
    odd = stored(marked.where("lacks").unionByName(repeated).distinct(), "odd-rows")
    for seed in count():
        keyed = stored(odd.withColumn("key", F.xxhash64(F.lit(seed), *odd.columns)), "odd-keys")
        apart = keyed.select("key").distinct().count() == keyed.count()
        if apart and ids.join(_few_broadcast(keyed.select("key")), "key", "left_semi").isEmpty():
            return keyed


def _with_key(rows: DataFrame, odd: DataFrame | None) -> DataFrame:
    """Rows with the columns of ``_marks``; these are replaced by ``key``, which is the doc_id of most rows."""
    marks = ["doc", "lacks", "h1", "h2"]
    if odd is None:
        return rows.withColumnRenamed("doc", "key").drop("lacks", "h1", "h2")
    return rows.join(_few_broadcast(odd), marks, "left").withColumn("key", F.coalesce("key", "doc")).drop(*marks)


def similar_groups(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, doc (its key), n_shingles and component.

    Two documents link when ``den`` * intersection >= ``num`` * union of their sets of ``size``-word
    shingles; component is the smallest doc_id that can be reached over links, or NO_ID without one.
    """
    groups = _grouped_rows(docs, _odd_keys(docs), size, num, den, tile)
    return groups.select("doc_id", doc_key().alias("doc"), "n_shingles", "component")


def _grouped_rows(docs: DataFrame, odd: DataFrame | None, size: int, num: int, den: int, tile: int) -> DataFrame:
    """doc_id, key, n_shingles, component and stays (whether it is its group's smallest) of every row."""
    spark = docs.sparkSession
    # inside, doc is the key of a row
    rows = _with_key(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *_marks()), odd)
    rows = rows.select("doc_id", F.col("key").alias("doc"), "text")
    # at most one row per bucket, whatever the input
    crowded = (
        rows.select("text")
        .mapInArrow(_crowded_buckets(size), "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    buckets = (crowded["bucket"].to_numpy(), crowded["n"].to_numpy())

    def prefixed(tokens: np.ndarray, lengths: np.ndarray) -> DataFrame:
        order = spark.sparkContext.broadcast((*buckets, tokens, lengths))
        return rows.mapInArrow(
            _prefixes(size, num, den, order),
            "doc_id bigint, doc bigint, n int, d1 bigint, d2 bigint, prefix array<bigint>, bitmap binary",
        )

    # a first try shows which postings have long lists; the longest of them go to the end of the order,
    # too. The order only decides how much work is done: any one that all documents share is right.
    tried = prefixed(np.zeros(0, np.uint64), np.zeros(0, np.int64)).select(F.explode("prefix").alias("token"))
    long_lists = (
        tried.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > LONG)
        .orderBy(F.desc("n"), "token")
        .limit(MOST_LONG)
        .toArrow()
    )
    tokens = long_lists["token"].to_numpy().astype(np.uint64)
    by_token = np.argsort(tokens)
    sets = stored(prefixed(tokens[by_token], long_lists["n"].to_numpy()[by_token]), "shingle-prefixes")
    filled = sets.where(F.col("n") > 0)
    classes = stored(filled.groupBy("d1", "d2").agg(F.min("doc").alias("node")), "shingle-classes")
    # one document of each class goes on; the others are few in most corpora, and are counted first
    narrow = filled.select("d1", "d2", "doc")
    others = narrow.join(classes, ["d1", "d2"]).where("doc <> node").select("d1", "d2", "doc")
    firsts = filled.join(_few_broadcast(stored(others, "copies")), ["d1", "d2", "doc"], "left_anti")
    postings = firsts.select(F.explode("prefix").alias("token"), "n", F.col("doc").alias("node"))
    ranged = postings.repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node")
    shared = stored(
        ranged.mapInArrow(
            _shared_postings(num, den),
            "token bigint, n int, node bigint, before bigint, near boolean",
        ),
        "shared-postings",
    )
    near = shared.where("near").select("node").distinct()
    bitmaps = filled.select(F.col("doc").alias("node"), "n", "bitmap").join(near, "node", "left_semi")
    chain = (
        shared.where(F.col("before").isNotNull())
        .select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b"))
        .distinct()
    )
    groups = connected_components(_links(_bitmap_filter(chain, bitmaps, num, den), rows, size, num, den))
    groups = stored(groups, "groups")
    listed = stored(
        shared.where("near")
        .join(groups, "node", "left")
        .select("token", "n", "node", F.coalesce("component", "node").alias("group")),
        "grouped-postings",
    )
    mixed = (
        listed.groupBy("token")
        .agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("length"))
        .where("low < high")
        .select("token", F.ceil(F.col("length") / tile).cast("int").alias("blocks"), "length")
    )
    order = ["token", "i", "j", "n", "node"]
    in_mixed = stored(listed.join(mixed, "token"), "mixed-postings")
    # the smallest tokens of a document: near copies have most of them in common
    least = F.array_sort(F.collect_set("token"))
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(FIRSTS - 1)), lambda i: F.coalesce(F.get("least", i), F.col("least")[0])
    )
    firsts_of = in_mixed.groupBy("node").agg(least.alias("least")).select("node", padded.alias("firsts"))
    rows_of = stored(in_mixed.join(firsts_of, "node"), "mixed-postings")
    short = rows_of.where(F.col("length") <= SHORT).select(
        "token", *[F.lit(0).alias(c) for c in ("i", "j")], "n", "node", "group", F.lit(0).alias("side"), "firsts"
    )
    short_pairs = (
        short.repartition("token")
        .sortWithinPartitions(*order)
        .mapInArrow(_tile_pairs(num, den, False), "a bigint, b bigint")
        .distinct()
    )
    # every block of a long list meets every block once: block b is in the tiles (i, b) and (b, j)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = (
        rows_of.where(F.col("length") > SHORT)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "token",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "n",
            "node",
            "group",
            F.col("block").alias("side"),
            "firsts",
        )
        .join(bitmaps.select("node", "bitmap").dropDuplicates(["node"]), "node")
        .select("token", "i", "j", "n", "node", "group", "side", "firsts", "bitmap")
        .repartition("token", "i", "j")
        .sortWithinPartitions(*order)
    )
    long_pairs = tiles.mapInArrow(_tile_pairs(num, den, True), "a bigint, b bigint").distinct()
    pairs = stored(long_pairs.unionByName(_bitmap_filter(short_pairs, bitmaps, num, den)), "late-pairs").distinct()
    later = stored(_links(pairs, rows, size, num, den), "late-links")
    bridges = (
        later.join(groups.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
        .join(groups.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
        .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        .distinct()
    )
    grouped = classes.join(groups, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("group"))
    if odd is not None:
        # rows of one doc_id belong together, those of empty texts as well
        repeated = odd.where("NOT lacks").select(F.col("doc").alias("doc_id"), F.col("key").alias("doc"))
        held = sets.select("doc", "d1", "d2").join(_few_broadcast(repeated), "doc").join(grouped, ["d1", "d2"], "left")
        held = stored(held.select("doc_id", F.coalesce("group", "doc").alias("a")).distinct(), "repeated-ids")
        bridges = bridges.unionByName(
            held.join(held.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").select("a", "b")
        )
    joined = connected_components(bridges).select(
        F.col("node").alias("group"), F.col("component").alias("joined")
    )
    final = grouped.join(joined, "group", "left").select("d1", "d2", F.coalesce("joined", "group").alias("component"))
    found = sets.select("doc_id", F.col("doc").alias("key"), F.col("n").cast("bigint").alias("n_shingles"), "d1", "d2")
    found = found.join(final, ["d1", "d2"], "left").select(
        "doc_id", "key", "n_shingles", F.coalesce("component", "key").alias("component")
    )
    if odd is None:
        return found.withColumn("stays", F.col("key") == F.col("component"))
    # a row of an empty text has its own key so far
    ends = joined.withColumnRenamed("group", "component")
    found = found.join(ends, "component", "left").withColumn("group", F.coalesce("joined", "component"))
    found = stored(found.select("doc_id", "key", "n_shingles", "group"), "grouped-rows")
    least = found.groupBy("group").agg(F.min("doc_id").alias("least"), F.min("key").alias("low"))
    alone = F.col("least").isNull() & (F.col("key") == F.col("low"))
    return found.join(least, "group").select(
        "doc_id",
        "key",
        "n_shingles",
        F.coalesce("least", F.lit(NO_ID)).alias("component"),
        F.when(F.col("doc_id").isNull(), alone).otherwise(F.col("doc_id") == F.col("least")).alias("stays"),
    )


def keep_one_of_each_group(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of similar documents only.

    Rows that repeat a doc_id that stays all stay. Of a group without any doc_id, the rows of one text stay.
    """
    odd = _odd_keys(docs)
    leaving = _grouped_rows(docs, odd, size, num, den, TILE).where("NOT stays").select("key").distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_marks())
    return _with_key(packed, odd).join(leaving, "key", "left_anti").select("row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = similar_groups(table(spark, sf_dir, "documents"), size=3, num=90, den=100)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component"))
    return groups.select("doc_id", "n_shingles", component.cast("bigint").alias("component_id"))
