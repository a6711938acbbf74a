"""Cleaning a corpus in five stages, each on all that the stage before kept.

1. language id: rejects texts without letters or without a language that the model is sure of;
2. line dedup: takes out lines that earlier documents have, and documents all whose words lay in them;
3. n-gram Jaccard join: keeps the smallest doc_id of each group of near copies (five-word shingles,
   similarity 0.8 or more);
4. decontamination: rejects documents of which one word in twenty or more lies in a benchmark passage;
5. SentencePiece: token ids of each text, and whether they decode to it.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwatch.llm.common import fold, stored, table
from rillwatch.llm.decontaminate import decontaminate
from rillwatch.llm.language import fit_language_model, keep_known_languages
from rillwatch.llm.line_dedup import dedup_lines
from rillwatch.llm.pieces import MARK, model_file, pieces_and_back
from rillwatch.llm.shingle_join import keep_one_of_each_group


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs, fit_language_model(docs, fold(5) != 0))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each_group(docs, size=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and round_trip of each document."""
    rows = pieces_and_back(docs.select("doc_id", "lang", "source", "text"), model_file())
    plain = F.replace(F.col("text"), F.lit(MARK), F.lit(" "))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"),
        F.col("decoded").eqNullSafe(plain).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

# a learned model and token ids are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
