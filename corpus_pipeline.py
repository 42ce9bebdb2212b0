"""A corpus pipeline over ``documents``: line-first quality rules, line-chunk
deduplication, near-duplicate removal, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage reads its input several times, so
stages are parted by Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import line_chunks, line_rules, mixing, near_duplicates, pieces
from riskspark.llm.common import table, use_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL: near-duplicate classes and Viterbi segmentations are no SQL expressions; tests/llm has a brute-force version.
ORACLE_SQL = None


def _with_text(text: Column, row: str = "") -> list[Column]:
    """The columns of documents with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(f"{row}{c}")).alias(c) for c in COLUMNS]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    judged = line_rules.line_first(docs.select(*COLUMNS))
    return judged.where("kept").select(*_with_text(F.col("clean_text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without multi-line chunks that an earlier document (or place) has."""
    return line_chunks.dedup_line_chunks(docs.select(*COLUMNS)).select(*_with_text(F.col("clean_text"), "row."))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, and whether decoding gives the text back."""
    return pieces.encode(docs.select(*COLUMNS), pieces.read_pieces(pieces.DEFAULT_MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
