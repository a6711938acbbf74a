"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; every run of one to three characters within them, hashed to DIMENSIONS features,
has the share of its occurrences as term frequency. Document frequencies come from all learning
documents. The weights are learned with follow-the-regularised-leader (per-coordinate steps, L1 and L2
penalties, so that most weights stay exactly zero) on at most PER_LANGUAGE documents a language, chosen
by a hash of doc_id and text; a temperature is then fitted on a part of that sample kept aside. Prediction reads
whole texts.

Defined cases: a null or empty text, or one without letters, is ``und`` with score 0; without any
labelled document every text is ``und``; extra columns are never read.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, doc_key, fold, steps, table, text_key

UNDETERMINED = "und"
DIMENSIONS = 1 << 15
PER_LANGUAGE = 1000  # bound of the sample that the weights are fitted on
EPOCHS = 3
BATCH = 32
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
STEP_BYTES = 300_000  # n-grams take some hundred bytes a character while they are counted
SCALE = 30.0  # term frequencies are shares: this brings inputs to the order of one
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numerals that are no decimal digits


def has_letter(text: str) -> bool:
    return any(found[0].isalpha() for found in _WORDLIKE.finditer(text))


def ngram_codes(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram of the texts one after the other, and the limits of each text.

    Each text is taken between two spaces, so an n-gram never reaches into the next text.
    """
    padded = [" " + t.lower() + " " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in padded], np.int64)
    ends = np.cumsum(sizes)
    last = np.repeat(ends, sizes)  # end of the text that a place belongs to
    at = np.arange(len(chars))
    codes = np.empty((len(chars), 3), np.uint64)
    ids = chars * np.uint64(0x9E3779B97F4A7C15)
    total = ids.copy()
    shift = np.uint64(64 - dimensions.bit_length() + 1)
    for n in range(3):
        if n:
            following = np.minimum(at + n, len(chars) - 1)
            # behind the text's end an n-gram stays as short as it is
            more = np.where(at + n < last, ids[following] ^ (ids[following] >> np.uint64(29)), np.uint64(0))
            total = total * np.uint64(0xBF58476D1CE4E5B9) + more
        codes[:, n] = ((total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> shift
    return codes.astype(np.int32).ravel(), np.concatenate([[0], ends * 3])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t.decode("utf-8", "replace") for t in byte_texts(batch.column("text"))]


def _document_frequencies(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(dimensions, np.int64), 0
        seen = np.zeros(dimensions, bool)
        for batch in steps(batches, STEP_BYTES):
            codes, limits = ngram_codes(_texts(batch), dimensions)
            for start, end in zip(limits[:-1], limits[1:]):
                some = codes[start:end]
                seen[some] = True
                counts += seen
                seen[some] = False
                docs += 1
        present = np.flatnonzero(counts)
        # the number of documents travels as one more feature
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(present, dimensions), pa.int32()), pa.array(np.append(counts[present], docs))],
            ["feature", "n"],
        )

    return run


def _sparse_rows(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, STEP_BYTES):
            codes, limits = ngram_codes(_texts(batch), dimensions)
            features, shares = [], []
            for start, end in zip(limits[:-1], limits[1:]):
                feature, times = np.unique(codes[start:end], return_counts=True)
                features.append(feature.astype("<u4").tobytes())
                shares.append((times / (end - start)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("aside"),
                    pa.array(features, pa.binary()),
                    pa.array(shares, pa.binary()),
                ],
                ["lang", "aside", "features", "shares"],
            )

    return run


def _probabilities(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(1, keepdims=True))
    return shifted / shifted.sum(1, keepdims=True)


class FollowTheLeader:
    """Per-coordinate FTRL-proximal for multinomial logistic regression with an elastic net."""

    def __init__(self, dimensions: int, classes: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((dimensions + 1, classes))  # the last row is the intercept
        self.n = np.zeros((dimensions + 1, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / step, 0.0)

    def learn(self, documents: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> None:
        """One step on a batch of sparse documents and their class numbers."""
        rows, inverse = np.unique(np.concatenate([d[0] for d in documents]), return_inverse=True)
        values = np.concatenate([d[1] for d in documents])
        owner = np.repeat(np.arange(len(documents)), [len(d[0]) for d in documents])
        dense = np.zeros((len(documents), len(rows)))
        dense[owner, inverse] = values
        weights = self.weights(rows)
        error = _probabilities(dense @ weights)
        error[np.arange(len(documents)), wanted] -= 1.0
        gradient = dense.T @ error / len(documents)
        before = self.n[rows]
        after = before + gradient**2
        self.z[rows] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.alpha * weights
        self.n[rows] = after

    def logits(self, documents, weights: np.ndarray) -> np.ndarray:
        return np.array([values @ weights[features] for features, values in documents])


def fit_temperature(logits: np.ndarray, wanted: np.ndarray) -> float:
    """Temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(wanted):
        return 1.0

    def loss(log_t: float) -> float:
        chances = _probabilities(logits / np.exp(log_t))[np.arange(len(wanted)), wanted]
        return float(-np.log(np.maximum(chances, 1e-12)).mean())

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_model(
    docs: DataFrame, learns: Column, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS
) -> dict:
    """Learn from the documents for which ``learns`` holds and lang is given.

    The result is bounded by ``dimensions`` and the number of languages: languages, scaled weights
    (features x languages), intercepts and temperature.
    """
    known = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return {"languages": []}
    frequencies = known.select("text").mapInArrow(
        _document_frequencies(dimensions), "feature int, n bigint"
    )
    counted = dict(map(tuple, frequencies.groupBy("feature").agg(F.sum("n")).collect()))
    total = counted.pop(dimensions, 0)
    idf = np.zeros(dimensions)
    at = np.array(sorted(counted), np.int64)
    idf[at] = np.log((1 + total) / (1 + np.array([counted[i] for i in at]))) + 1
    # a share of each language that gives about the bound, by a hash of doc_id and text
    draw = F.pmod(F.xxhash64(F.lit("draw"), doc_key(), text_key()), F.lit(1_000_000))
    share = F.lit(0)
    for language in languages:
        most = int(min(1.0, per_language / sizes[language]) * 1_000_000)
        share = F.when(F.col("lang") == language, F.lit(most)).otherwise(share)
    sample = known.where(draw < share).select(
        "text", "lang", (F.pmod(F.xxhash64(F.lit("aside"), doc_key(), text_key()), F.lit(5)) == 0).alias("aside")
    )
    rows = (
        sample.select("text", "lang", "aside")
        .mapInArrow(_sparse_rows(dimensions), "lang string, aside boolean, features binary, shares binary")
        .orderBy(F.xxhash64("features", "shares"))
        # rows that repeat are drawn all or none
        .limit(2 * per_language * len(languages))
        .collect()
    )
    number = {language: i for i, language in enumerate(languages)}

    def document(row):
        features = np.frombuffer(row["features"], "<u4").astype(np.int64)
        values = np.frombuffer(row["shares"], "<f4").astype(np.float64) * idf[features] * SCALE
        return np.append(features, dimensions), np.append(values, 1.0)

    aside = [r for r in rows if r["aside"]]
    learned = [r for r in rows if not r["aside"]] or rows
    model = FollowTheLeader(dimensions, len(languages))
    random = np.random.default_rng(7)
    documents = [document(r) for r in learned]
    wanted = np.array([number[r["lang"]] for r in learned])
    for _ in range(EPOCHS):
        order = random.permutation(len(documents))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            model.learn([documents[i] for i in some], wanted[some])
    weights = model.weights()
    check = [document(r) for r in aside]
    logits = model.logits(check, weights) if check else np.zeros((0, len(languages)))
    temperature = fit_temperature(logits, np.array([number[r["lang"]] for r in aside], np.int64))
    scaled = weights[:-1] * (idf * SCALE)[:, None] / temperature
    return {
        "languages": languages,
        "weights": np.ascontiguousarray(scaled.T),
        "intercept": weights[-1] / temperature,
        "temperature": temperature,
    }


def predict_language(text: Column, model: dict, spark: SparkSession) -> Column:
    """Struct of lang_pred and score (its calibrated probability) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(column: pa.Array) -> pa.Array:
        known = shared.value
        names, scores = [], []
        for batch in steps([pa.RecordBatch.from_arrays([column], ["text"])], STEP_BYTES):
            texts = _texts(batch)
            lettered = np.array([has_letter(t) for t in texts])
            if not known["languages"] or not lettered.any():
                names.extend([UNDETERMINED] * len(texts))
                scores.extend([0.0] * len(texts))
                continue
            weights = known["weights"]
            codes, limits = ngram_codes(texts, weights.shape[1])
            sums = np.stack([np.add.reduceat(row[codes], limits[:-1]) for row in weights], axis=1)
            chances = _probabilities(sums / np.diff(limits)[:, None] + known["intercept"])
            best = chances.argmax(1)
            names.extend(known["languages"][b] if yes else UNDETERMINED for b, yes in zip(best, lettered))
            scores.extend(np.where(lettered, chances[np.arange(len(best)), best], 0.0).tolist())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
        )

    return predicted(text)


def keep_known_languages(docs: DataFrame, model: dict, min_score: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text has no language or none that the model is sure of."""
    row = F.struct(*[docs[c] for c in docs.columns])
    rated = docs.select(row.alias("row"), predict_language(F.col("text"), model, docs.sparkSession).alias("found"))
    sure = (F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= min_score)
    return rated.where(sure).select("row.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(5) == 0
    model = fit_language_model(docs, ~held_out)
    found = predict_language(F.col("text"), model, spark)
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )
