"""Corpus pipeline: documents that pass the quality rules and the toxicity classifier, one of each group of near copies,
without secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. A stage's result is a Parquet table in
the shared folder before the next stage reads it. What native operators make is gathered into tasks by its
number of rows first (common.gathered); stages whose tasks run Python keep theirs, as all of a task's batches would be held
until it ends. Columns of ``docs`` beside those of documents are dropped, whatever their
names; an empty table goes through all stages as one; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import jaccard_join, packing, quality, secrets, toxicity
from marlstone.llm.common import gathered, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; rows without a source have no host that could
    reject them; repeated rows are judged each on their own."""
    rows = docs.count()
    return gathered(quality.keep_good(gathered(docs, rows)).select(*COLUMNS), rows)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted to the labelled ones among them, doesn't reject. Without labels of both
    classes none is rejected; rows without an id are scored but not learnt from."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id, of equal ids that with the smallest hash of its
    text. Rows without an id stay where none of their class has one, one for each class."""
    return gathered(jaccard_join.keep_one(docs).select(*COLUMNS), docs.count())


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars is the new length of a changed text."""
    return secrets.redacted(docs.select(*COLUMNS))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences; a null or empty text is one piece of length 1."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", good_documents),
    ("toxicity", clean_documents),
    ("near copies", distinct_documents),
    ("secrets", masked_documents),
    ("packing", packed_documents),
]

#: The classifier, the random paths and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage-{number}")
    return docs
