"""Token ids in segments, with Elias-Fano coded document ends.

Documents are range partitioned by doc_id, encoded where they lie, and packed into segments: one array
of ids, and the ends of the documents within it as an Elias-Fano sequence. That takes about
2 + log2(ids per document) bits per document, and a select structure over the upper bits finds any
document's ids without a table of 64-bit offsets. Spark's writer commits the segments, so a lost task
leaves nothing half written, and any file system that Spark knows will do.

Segment layout, little endian: magic, bytes per id, number of documents, number of ids, low bits per
end, number of upper bytes; then low bits, upper bits, select samples, ids.

Defined cases: null text is empty and yields the end id alone; rows without doc_id come first; rows
that share a doc_id follow each other in the order of a hash of their text; an empty table has no
segments.
"""

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_texts, steps, stored, table, text_key
from .encoders import WordMemo, joined

MAGIC = b"RWT1"
HEADER = "<4sBxxxIIII"
SAMPLE = 64  # every so many documents, the place of their bit is kept
SEGMENT_IDS = 1_000_000
END_ID = 1
KNOWN_WORDS = 700_000  # words that a worker remembers: encoding them anew is what costs most here
# characters that a word may end with, apart from its core; none of them begins a contraction
_TAIL = b".,!?;:|$%&*#()"
# letters that are composed already and whose lower case is one letter
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

# fixed values: preparation that lower-cases, composes, drops white space and cuts between letters,
# numerals and other characters, so that a text's ids are those of its words
_WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def encodes_words_apart(definition: str) -> bool:
    """Whether the definition is known to encode a text as the sequence of its words."""
    parts = json.loads(definition)
    return all(parts[name] == wanted for name, wanted in _WORDWISE.items())


class EliasFano:
    """Non-decreasing whole numbers in near-minimal space."""

    def __init__(self, count: int, low_bits: int, low: bytes, upper: bytes, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.upper, self.samples = count, low_bits, low, upper, samples

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        count = len(values)
        last = int(values[-1]) if count else 0
        low_bits = max(0, int(np.floor(np.log2(last / count)))) if count and last > count else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> low_bits) + np.arange(count)
        upper = np.zeros((last >> low_bits) + count + 1, np.uint8)
        upper[ones] = 1
        packed = np.packbits(upper, bitorder="little").tobytes()
        return cls(count, low_bits, low, packed, ones[::SAMPLE].astype("<u4"))

    def _low(self, first: int, end: int) -> np.ndarray:
        start = first * self.low_bits
        stop = end * self.low_bits
        some = np.frombuffer(self.low, np.uint8)[start // 8 : -(-stop // 8)]
        bits = np.unpackbits(some, bitorder="little")[start % 8 : start % 8 + stop - start]
        return bits.reshape(end - first, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))

    def select(self, index: int) -> int:
        """The number at ``index``, from the nearest sample on."""
        at = int(self.samples[index // SAMPLE])
        rest, byte = index % SAMPLE, at // 8
        window = 64
        while True:
            some = np.frombuffer(self.upper, np.uint8)[byte : byte + window]
            ones = np.flatnonzero(np.unpackbits(some, bitorder="little")) + byte * 8
            ones = ones[ones >= at]
            if len(ones) > rest:
                break
            window *= 2
        return ((int(ones[rest]) - index) << self.low_bits) + int(self._low(index, index + 1)[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))
        return ((ones - np.arange(self.count)) << self.low_bits) + self._low(0, self.count)


def write_segment(ids: bytes, width: int, lengths: list[int]) -> bytes:
    """Pack the ids of consecutive documents, ``width`` bytes each."""
    ends = EliasFano.build(np.cumsum(lengths))
    head = struct.pack(HEADER, MAGIC, width, len(lengths), len(ids) // width, ends.low_bits, len(ends.upper))
    return b"".join([head, ends.low, ends.upper, ends.samples.tobytes(), ids])


class Segment:
    """A packed segment: ``document(i)`` finds one document's ids, ``ends()`` all ends."""

    def __init__(self, payload: bytes):
        magic, self.width, count, self.n_ids, low_bits, upper = struct.unpack_from(HEADER, payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize(HEADER)
        low, at = payload[at : at + -(-count * low_bits // 8)], at + -(-count * low_bits // 8)
        bits, at = payload[at : at + upper], at + upper
        sampled = -(-count // SAMPLE)
        samples, at = np.frombuffer(payload, "<u4", sampled, at), at + 4 * sampled
        self.n_docs = count
        self._ends = EliasFano(count, low_bits, low, bits, samples)
        self.ids = np.frombuffer(payload, f"<u{self.width}", self.n_ids, at)

    def ends(self) -> np.ndarray:
        return self._ends.values()

    def document(self, index: int) -> np.ndarray:
        start = self._ends.select(index - 1) if index else 0
        return self.ids[start : self._ends.select(index)]


class _CutWords(WordMemo):
    """Encoded words; punctuation behind a word is cut off, where the tokenizer cuts anyway."""

    def learn(self, words: Iterable[bytes]) -> None:
        whole, cut = [], []
        for word in set(words):
            if word in self:
                continue
            core = word.rstrip(_TAIL)
            if len(core) < len(word) and core[-1:].isalnum():
                cut.append((word, core, word[len(core) :]))
            else:
                whole.append(word)
        self.update(zip(whole, self.encode(whole)))
        parts = [p for p in {p for some in cut for p in some[1:]} if p not in self]
        self.update(zip(parts, self.encode(parts)))
        self.update([(word, self[core] + self[tail]) for word, core, tail in cut])


class TextEncoder:
    """A tokenizer of the tokenizers library, with a memory of the words that it has met.

    With ``by_word`` a text's ids are those of its words, whatever surrounds them, and a word of plain
    Latin letters needs neither normaliser nor splitter; only definitions that :func:`encodes_words_apart`
    knows allow that. Texts that may hold a special token are encoded whole.
    """

    def __init__(self, definition: str, width: int, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.plain = Tokenizer.from_str(self._for_word_lists(definition))
        self.width = width
        self.kind = f"<u{width}"
        model = json.loads(definition)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends_word = np.zeros(2 ** (8 * min(width, 3)), bool)
        self.ends_word[[i for piece, i in model["vocab"].items() if suffix and piece.endswith(suffix)]] = True
        self.by_word = by_word
        self.marks = [t["content"].encode() for t in json.loads(definition).get("added_tokens", ())]
        self.mark = os.path.commonprefix(self.marks) if self.marks else None
        self.words = _CutWords(self._encode_parts, KNOWN_WORDS)

    @staticmethod
    def _for_word_lists(definition: str) -> str:
        """The same model behind its byte alphabet, for words that a space parts."""
        parts = json.loads(definition)
        splitters = (parts["pre_tokenizer"] or {}).get("pretokenizers", [parts["pre_tokenizer"]])
        alphabet = [s | {"use_regex": False} for s in splitters if s and s["type"] == "ByteLevel"]
        at_spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        parts.update(normalizer=None, pre_tokenizer={"type": "Sequence", "pretokenizers": [at_spaces, *alphabet]})
        return json.dumps(parts)

    def _encode_simple(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of plain letters, all in one call; a word's last id is known by its suffix."""
        ids = np.asarray(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return [self.whole(w.encode()) for w in words]
        limits = (ends * self.width).tolist()
        raw = ids.astype(self.kind).tobytes()
        return [raw[a:b] for a, b in zip([0, *limits[:-1]], limits)]

    def _encode_parts(self, words: list[bytes]) -> list[bytes]:
        """Ids of words and ends of words that the tokenizer keeps apart from what is around them."""
        texts = [w.decode() for w in words]
        simple = [_LETTERS.fullmatch(t) is not None for t in texts]
        known = iter(self._encode_simple([t.lower() for t, s in zip(texts, simple) if s]) if any(simple) else ())
        others = [t for t, s in zip(texts, simple) if not s]
        coded = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        return [next(known) if s else np.asarray(next(coded).ids, self.kind).tobytes() for s in simple]

    def whole(self, text: bytes) -> bytes:
        return np.asarray(
            self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind
        ).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        plain = [None if self.mark is not None and self.mark in t else t.lower().split() for t in texts]
        self.words.trim()
        found = joined(
            self.words.look_up([w for some in plain if some is not None for w in some]),
            [len(some or ()) for some in plain],
        )
        return [self.whole(text) if some is None else ids for text, some, ids in zip(texts, plain, found)]


def _packed(model, end_id: int, by_word: bool, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = model.value  # one object per worker, and so is what it remembers
        width = shared["width"]
        if "encoder" not in shared:
            shared["encoder"] = TextEncoder(shared["definition"], width, by_word)
        encoder = shared["encoder"]
        end = end_id.to_bytes(width, "little")
        part = TaskContext.get().partitionId()
        seq, ids, lengths, docs = 0, [], [], []

        def segment():
            payload = write_segment(b"".join(ids), width, lengths)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                ["part", "seq", "n_tokens", "doc_ids", "payload"],
            )

        held = 0
        for batch in steps(batches):
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(byte_texts(batch.column("text")))):
                ids.append(found + end)
                lengths.append(len(found) // width + 1)
                docs.append(doc)
                held += lengths[-1]
                if held >= segment_ids:
                    yield segment()
                    seq, ids, lengths, docs, held = seq + 1, [], [], [], 0
        if docs:
            yield segment()

    return run


def token_segments(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = END_ID,
    by_word: bool | None = None,
    segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """Encode all texts and write them as segments in ascending doc_id order; returns the stored table.

    Texts are encoded word by word where the definition allows it and ``by_word`` is not False.

    ``tokenizer_path`` names a definition file of the tokenizers library on the driver; its text (a few
    MB, whatever the input) is broadcast. Columns: part and seq (order), n_tokens, doc_ids, payload.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    if by_word and not encodes_words_apart(definition):
        raise ValueError("this tokenizer does not encode words apart from each other")
    by_word = encodes_words_apart(definition) if by_word is None else by_word
    vocabulary = json.loads(definition)["model"]["vocab"]
    most = max(end_id, len(vocabulary), *(t["id"] for t in json.loads(definition).get("added_tokens", ())))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast({"definition": definition, "width": 2 if most < 2**16 else 4})
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key().alias("_text"))
        .repartitionByRange("doc_id", "_text")
        .sortWithinPartitions("doc_id", "_text")
    )
    packed = ordered.mapInArrow(
        _packed(model, end_id, by_word, segment_ids),
        "part int, seq int, n_tokens bigint, doc_ids array<bigint>, payload binary",
    )
    return stored(packed, "token-segments")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            segment = Segment(batch.column("payload")[row].as_py())
            ends = segment.ends()
            starts = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(segment.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
            count = segment.n_docs
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part").take(pa.array([row] * count, pa.int64())),
                    batch.column("seq").take(pa.array([row] * count, pa.int64())),
                    pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def segment_documents(segments: DataFrame) -> DataFrame:
    """Read segments back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    sizes = segments.select("part", "seq", "n_tokens")
    # one row per write task meets in one place, and then the segments of each task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("_part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_base")
    ).join(parts, "part")
    rows = segments.select("part", "seq", "doc_ids", "payload").mapInArrow(
        _unpacked,
        "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint",
    )
    return rows.join(bases, ["part", "seq"]).select(
        "doc_id",
        (F.col("_part_base") + F.col("_base") + F.col("inner")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return segment_documents(token_segments(table(spark, sf_dir, "documents"), tokenizer_path))
