"""Benchmark decontamination with built-in functions only.

Benchmark texts become windows of 13 words (a shorter text is one window). Their hashes are counted first.
Up to MAX_SET of them go to every task as a set inside the plan, up to MAX_BROADCAST as a broadcast hash
table; only beyond that are the documents' windows shuffled. Each document's windows are looked up there,
every hit is verified word by word against the windows themselves, and the result says which words are hit
and by which items. With a set or a broadcast table texts never move, only hits do.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.

Defined cases: null or empty texts have no words, are never hit and never contaminated; an item without
words has no window; an empty benchmark hits nothing; repeated rows are judged each on their own.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, few_broadcast, stored, table, text_key

WINDOW = 13
MAX_SET = 20_000
MAX_BROADCAST = 2_000_000  # hashes, of some 50 bytes each in a task's hash table
FEW_IDS = 200_000  # ids of documents that are broadcast
SHARE = 20  # a document is contaminated when one word in so many is hit
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_REST = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Normalised words of a text; lower() is faster than translate() and the same on ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(folded, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, len, window (words joined by a space) and hash of every window of every item."""
    words = benchmark.select("item_id", word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    cut = words.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("cut")
    )
    return cut.select(
        "item_id",
        F.size("cut").alias("len"),
        F.array_join("cut", " ").alias("window"),
        F.xxhash64("cut").alias("hash"),
    ).distinct()


def _starts(length: int) -> Column:
    """Places (from 1) where a window of this length begins."""
    return F.when(F.size("words") >= length, F.sequence(F.lit(1), F.size("words") - length + 1)).otherwise(
        F.array().cast("array<int>")
    )


def _candidates(length: int, places: Column) -> Column:
    return F.transform(
        places,
        lambda i: F.struct(
            i.alias("pos"),
            F.lit(length).alias("len"),
            F.array_join(F.slice("words", i, length), " ").alias("window"),
        ),
    )


def _by_set(words: DataFrame, hashes: dict[int, list[int]]) -> DataFrame:
    """Candidate hits of each document, found in sets of hashes by window length."""
    found = []
    for length, wanted in sorted(hashes.items()):
        values = ",".join(f"{h}L" if h > -(2**63) else "-9223372036854775807L - 1L" for h in wanted)
        within = f"filter(_starts{length}, i -> xxhash64(slice(words, i, {length})) in ({values}))"
        words = words.withColumn(f"_starts{length}", _starts(length))
        words = words.withColumn(f"_at{length}", F.expr(within))
        found.append(_candidates(length, F.col(f"_at{length}")))
    hits = F.concat(*found) if found else F.array().cast("array<struct<pos:int,len:int,window:string>>")
    return words.withColumn("hits", hits)


def _by_table(words: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark of any size: the hash of every window of every document is looked up in the
    table ``wanted``, which is broadcast or not, and the words of documents with a hit are read again."""
    keys = ["doc", "text_hash"]

    def hashes(length: int) -> Column:
        return F.transform(
            _starts(length),
            lambda i: F.struct(
                i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice("words", i, length)).alias("hash")
            ),
        )

    every = words.select(*keys, F.explode(F.concat(*map(hashes, lengths))).alias("at")).select(*keys, "at.*")
    found = every.join(wanted, ["len", "hash"]).groupBy(*keys)
    places = stored(found.agg(F.collect_set(F.struct("pos", "len")).alias("places")), "benchmark-places")
    hits = F.transform(
        "places",
        lambda p: F.struct(
            p["pos"].alias("pos"),
            p["len"].alias("len"),
            F.array_join(F.slice("words", p["pos"], p["len"]), " ").alias("window"),
        ),
    )
    none = F.array().cast("array<struct<pos:int,len:int,window:string>>")
    marked = words.join(few_broadcast(places, FEW_IDS), keys, "left")
    return marked.withColumn("hits", F.when(F.col("places").isNull(), none).otherwise(hits)).drop("places")


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    max_set: int = MAX_SET,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, doc and text_hash (its keys), n_words, places, items.

    ``places`` are the numbers (from 1) of the words inside any occurrence of a window, ``items`` the
    ids of the benchmark items these windows belong to, as sorted texts.
    """
    windows = stored(benchmark_windows(benchmark, size), "benchmark-windows")
    words = docs.select(
        "doc_id", doc_key().alias("doc"), text_key().alias("text_hash"), word_array(F.col("text")).alias("words")
    )
    # never more than the bound comes to the driver
    hashes = windows.select("len", "hash").distinct().limit(max_set + 1).collect()
    if len(hashes) <= max_set:
        by_length: dict[int, list[int]] = {}
        for length, value in hashes:
            by_length.setdefault(length, []).append(value)
        marked = _by_set(words, by_length)
    else:
        lengths = [row[0] for row in windows.select("len").distinct().collect()]  # at most ``size``
        wanted = stored(windows.select("len", "hash").distinct(), "window-hashes")
        marked = _by_table(words, few_broadcast(wanted, max_broadcast), lengths)
    rows = stored(
        marked.select("doc_id", "doc", "text_hash", F.size("words").cast("bigint").alias("n_words"), "hits"),
        "benchmark-candidates",
    )
    # repeated rows have the same hits, so that one of them is enough
    hits = (
        rows.where(F.size("hits") > 0)
        .dropDuplicates(["doc", "text_hash"])
        .select("doc", "text_hash", F.explode("hits").alias("hit"))
        .select("doc", "text_hash", "hit.*")
    )
    spans = F.flatten(
        F.transform(
            F.collect_set(F.struct("pos", "len")), lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)
        )
    )
    verified = (
        hits.join(windows, ["len", "window"])
        .groupBy("doc", "text_hash")
        .agg(
            F.array_distinct(spans).alias("places"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    return rows.drop("hits").join(verified, ["doc", "text_hash"], "left").withColumns(
        {
            "places": F.coalesce("places", F.array().cast("array<int>")),
            "items": F.coalesce("items", F.array().cast("array<string>")),
        }
    )


def is_contaminated(n_words: Column, n_hit: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, cut: bool = False, size: int = WINDOW, share: int = SHARE
) -> DataFrame:
    """``docs`` without contaminated documents or, with ``cut``, without the words that are hit.

    Without ``cut`` all other documents stay as they are. With ``cut`` every document stays; a word that
    is hit goes with the characters between it and the word before, and ``n_chars`` is counted anew.
    """
    found = benchmark_hits(docs, benchmark, size).dropDuplicates(["doc", "text_hash"])
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        doc_key().alias("doc"),
        text_key().alias("text_hash"),
    )
    if not cut:
        bad = found.where(is_contaminated(F.col("n_words"), F.size("places"), share))
        bad = stored(bad.select("doc", "text_hash"), "contaminated")
        kept = packed.join(few_broadcast(bad, FEW_IDS), ["doc", "text_hash"], "left_anti")
        return kept.select("row.*")
    touched = found.where(F.size("places") > 0).select("doc", "text_hash", "places")
    text = F.col("row.text")
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    left = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("places", i + 1)), "")
    rest = F.regexp_extract(text, _REST, 0)
    mended = packed.join(touched, ["doc", "text_hash"], "left").withColumn(
        "_left", F.when(F.col("places").isNull(), text).otherwise(F.concat(left, rest))
    )
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("_left").alias(name))
        elif name == "n_chars":
            counted = F.char_length("_left").cast(docs.schema[name].dataType)
            columns.append(F.coalesce(counted, F.col("row.n_chars")).alias(name))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return mended.select(*columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("places").cast("bigint")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), n_hit).alias("contaminated"),
    )
