"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Input handling is that of a model with identity normalisation: a space is put before the text, spaces
become the mark U+2581 (inside, the trie holds them as plain spaces), and characters without a piece
become byte pieces. A text holding U+2581 itself reads back with a space there; every other text reads
back exactly.

No piece goes on behind a mark that follows another character, so a text's best split is made up of
those of its words; each distinct word is split once per task, all new words of a step together.

A model of the merge kind stores ranks instead of log scores. With ``merge_ranks`` a rank r becomes the
logarithm of a Zipf share, -ln(r + 3); scores of a model of the unigram kind are used as they are.

Defined cases: null text has no ids and decodes to null; empty text has no ids and decodes to empty.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_texts, steps, table
from .encoders import WordMemo, joined
from .trie import ROOT, DoubleArrayTrie

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def piece_scores(scores: np.ndarray, ordinary: np.ndarray, merge_ranks: bool) -> np.ndarray:
    """Log scores of the ordinary pieces: given, or from the ranks of a model of the merge kind."""
    if merge_ranks:
        scores = -np.log(np.maximum(-scores, 0) + 3.0)
    return np.where(ordinary, scores, 0.0)


def read_model(path: str, merge_ranks: bool = True) -> dict:
    """Pieces, log scores and byte pieces of a model file: plain values of bounded size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    special = [
        model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
        for i in range(count)
    ]
    ordinary = ~np.array(special, bool)
    scores = np.array([model.get_score(i) for i in range(count)])
    pieces = [model.id_to_piece(i) for i in range(count)]
    bytes_at = {int(pieces[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
    if len(bytes_at) != 256:
        raise ValueError("the model has no byte pieces")
    return {
        "pieces": pieces,
        "ordinary": ordinary,
        "scores": piece_scores(scores, ordinary, merge_ranks),
        "byte_ids": np.array([bytes_at[b] for b in range(256)], np.int32),
    }


class PieceModel:
    """Encodes and decodes texts with the pieces of a model."""

    def __init__(self, pieces, ordinary, scores, byte_ids):
        inner = [p.replace(MARK, " ").encode() for p in pieces]
        self.trie = DoubleArrayTrie.build({p: i for i, p in enumerate(inner) if ordinary[i]})
        self.scores = np.asarray(scores, np.float64)
        self.byte_ids = byte_ids
        self.unknown = float(self.scores[ordinary].min()) - UNKNOWN_PENALTY
        self.width = 2 if len(pieces) < 2**16 else 4
        self.kind = f"<u{self.width}"
        if any(re.search(b"[^ ] ", p) for p, plain in zip(inner, ordinary) if plain):
            raise ValueError("a piece goes on behind a word's end")
        lines = not any(b"\n" in p for p, plain in zip(inner, ordinary) if plain)
        # a line end without a piece is a word of its own
        self.words = re.compile(rb" *[^ \n]+|\n| +" if lines else rb" *[^ ]+| +")
        self.table = [p if plain else b"" for p, plain in zip(inner, ordinary)]
        for byte, at in enumerate(byte_ids):
            self.table[at] = bytes([byte])
        self.memo = WordMemo(self.split_words)

    def _matches(self, data: np.ndarray, limits: np.ndarray):
        """Pieces at every place of the joined words: start, length, piece or -1, by place and length."""
        sizes = np.diff(limits)
        end = np.repeat(limits[1:], sizes)
        starts = np.arange(len(data))
        head = (data & 0xC0) != 0x80  # begins a character
        lead = data[:, None] >= np.array([0xC0, 0xE0, 0xF0])
        char = 1 + lead.sum(1)
        at, states = starts[head], np.full(int(head.sum()), ROOT, np.int32)
        single = np.zeros(len(data), bool)
        found = []
        length = 0
        while len(at):
            states = self.trie.step(states, data[at + length])
            length += 1
            keep = states > 0
            at, states = at[keep], states[keep]
            value = self.trie.value[states]
            hit = value >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), value[hit]))
            single[at[hit & (char[at] == length)]] = True
            keep = at + length < end[at]
            at, states = at[keep], states[keep]
        lone = starts[head & ~single]
        found.append((lone, np.minimum(char[lone], end[lone] - lone), np.full(len(lone), -1)))
        start, size, piece = (np.concatenate(c) for c in zip(*found))
        return start.astype(np.int64), size.astype(np.int64), piece.astype(np.int64)

    def split_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of the best split of each word; of equal scores the earlier, longer pieces win."""
        limits = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        data = np.frombuffer(b"".join(words), np.uint8)
        start, size, piece = self._matches(data, limits)
        word_start = np.repeat(limits[:-1], np.diff(limits))
        inner = start - word_start[start]
        order = np.lexsort((size, inner))
        start, size, piece, inner = start[order], size[order], piece[order], inner[order]
        score = np.where(piece < 0, self.unknown, self.scores[piece])
        # places are counted with one more per word, so that a word's end is no other word's start
        word = np.repeat(np.arange(len(words)), np.diff(limits))
        begin = start + word[start]
        stop = begin + size
        best = np.full(len(data) + len(words), -np.inf)
        best[limits[:-1] + np.arange(len(words))] = 0.0
        chosen = np.full(len(best), -1, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(inner)) + 1, [len(inner)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            # within one step each end belongs to one word and one length
            total = best[begin[a:b]] + score[a:b]
            better = total > best[stop[a:b]]
            best[stop[a:b][better]] = total[better]
            chosen[stop[a:b][better]] = np.flatnonzero(better) + a
        # walk back from all ends together
        at = limits[1:] + np.arange(len(words))
        owner = np.arange(len(words))
        first = limits[:-1] + owner
        trail = []
        while len(at):
            step = chosen[at]
            trail.append((owner, step))
            at = begin[step]
            on = at > first[owner]
            at, owner = at[on], owner[on]
        owners = np.concatenate([t[0] for t in trail])
        steps_ = np.concatenate([t[1] for t in trail])
        back = np.concatenate([np.full(len(t[0]), i) for i, t in enumerate(trail)])
        order = np.lexsort((-back, owners))
        owners, steps_ = owners[order], steps_[order]
        pieces = piece[steps_]
        known = pieces >= 0
        counts = np.where(known, 1, size[steps_])
        places = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), self.kind)
        ids[places[known]] = pieces[known]
        for step, place in zip(steps_[~known], places[~known]):
            some = data[start[step] : start[step] + size[step]]
            ids[place : place + len(some)] = self.byte_ids[some]
        ends = np.cumsum(np.bincount(owners, counts, len(words)).astype(np.int64)) * self.width
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, ``width`` bytes each."""
        mark = MARK.encode()
        cut = [self.words.findall(b" " + t.replace(mark, b" ")) if t else [] for t in texts]
        self.memo.trim()
        return joined(self.memo.look_up([w for some in cut for w in some]), map(len, cut))

    def decode(self, ids) -> bytes:
        """Bytes of a list of ids, without the space that encoding puts first."""
        return b"".join(map(self.table.__getitem__, ids)).removeprefix(b" ")


def _shared_model(shared: dict) -> PieceModel:
    if "ready" not in shared:
        shared["ready"] = PieceModel(**shared["model"])
    return shared["ready"]


def _encoded(pieces: PieceModel, column: pa.Array) -> pa.Array:
    """Lists of ids of the texts of one step."""
    found = pieces.encode(byte_texts(column))
    limits = np.concatenate([[0], np.cumsum([len(f) // pieces.width for f in found])])
    values = np.frombuffer(b"".join(found), pieces.kind).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(values), mask=column.is_null())


def _decoded(pieces: PieceModel, column: pa.ListArray) -> pa.Array:
    """Texts of lists of ids."""
    out = []
    for row in range(len(column)):
        found = column[row]
        out.append(
            pieces.decode(found.values.to_numpy().tolist()).decode("utf-8", "replace") if found.is_valid else None
        )
    return pa.array(out, pa.string())


def encode_pieces(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", merge_ranks: bool = True
) -> DataFrame:
    """Add the array ``ids`` of piece ids of ``text``; the model file is read on the driver."""
    model = docs.sparkSession.sparkContext.broadcast({"model": read_model(model_path, merge_ranks)})

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        pieces = _shared_model(model.value)
        cut = steps([pa.RecordBatch.from_arrays([column], ["text"])])
        parts = [_encoded(pieces, batch.column("text")) for batch in cut]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids, encoded(F.col(text)))


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of the piece ids; bytes that are no valid text become U+FFFD."""
    model = rows.sparkSession.sparkContext.broadcast({"model": read_model(model_path)})

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return _decoded(_shared_model(model.value), column)

    return rows.withColumn(text, decoded(F.col(ids)))


def pieces_and_back(docs: DataFrame, model_path: str, merge_ranks: bool = True) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of ``text``, and ``decoded``, the text of these ids.

    One step of one worker does both. Two column functions in a row would be one Python node, which
    computes the ids once for the column and once more for the text read back from them.
    """
    model = docs.sparkSession.sparkContext.broadcast({"model": read_model(model_path, merge_ranks)})
    names = [*docs.columns, "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _shared_model(model.value)
        for batch in steps(batches):
            ids = _encoded(pieces, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, _decoded(pieces, ids)], names)

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("ids array<int>, decoded string").fields])
    return docs.mapInArrow(run, schema)


def model_file(model_path: str | None = None) -> str:
    """The given model file or the public one with byte pieces."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return model_path


def piece_round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, number and checksum of the ids of each text, and whether they decode to the text."""
    read = pieces_and_back(docs.select("doc_id", "text"), model_path)
    plain = F.replace(F.col("text"), F.lit(MARK), F.lit(" "))
    return read.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(plain).alias("round_trip"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"), model_file(model_path))
