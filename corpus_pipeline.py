"""From raw documents to packed training sequences, five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of documents,
further columns too, whatever their names. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, neardup, packing, secrets
from tidemark.llm.common import read, small_batches
from tidemark.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or less than an even chance) go.

    So null, empty and letterless texts go, and all rows where no document has a label. Long
    texts are read whole; rows that repeat a document stay or go together; languages that are
    equally likely go by name.
    """
    small_batches(spark)
    return langid.filter_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Null and empty texts and rows of a null id stay; of rows that repeat an id one stays,
    that of the smallest hash of its text. Long texts are compared whole.
    """
    small_batches(spark)
    return neardup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay.

    Null and empty texts stay as they are, long ones are scanned whole, repeated rows are
    rewritten alike; spans that overlap are one.
    """
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept once or left out, so that sources approach their target weights.

    A null text has no words, the null source comes last, sources of equal ratio go by name;
    rows equal in id and text share their coin. Long texts are counted whole.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document with its place.

    A null or empty text is a piece of one id; long ones are cut into pieces; every repeated
    row is packed. Columns other than doc_id and text end here.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned language model and the packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None
