"""From raw documents to token ids: toxicity, near duplicates, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one. All but the last return the
columns of ``docs``, whatever they are called; every stage gives an empty table for an empty one and keeps long texts whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import mixing, ngram_join, pieces, toxicity
from relspark.sources.shared import new_folder


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain doesn't call toxic. Rows that are equal in text stay or go together; a null, empty or wordless
    text is judged by its shape; a null doc_id, or one that repeats, is a document like any other, but its labels aren't used
    (of a repeated one, the largest label counts)."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id, and one of the rows that repeat it. Rows without words or
    without doc_id stay."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them. A null source is one of its own; a text without words counts nothing towards a target;
    rows that are equal in all columns share their copies; a source without words gives none."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, in column ids (in place of one of that name). A null or empty text has none; equal texts have
    equal ones."""
    return pieces.encode(docs, pieces.read_model())


STAGES = [("toxicity", safe), ("ngram_join", near_duplicates), ("mixing", mix), ("sentencepiece", encode)]

#: MinHash, trained models and Viterbi have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = f"{new_folder(spark, 'pipeline')}/{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)
