"""The corpus pipeline: quality, lines, near duplicates, mixture, token ids.

Each stage works on all rows that the one before it kept, written as Parquet in
between. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimsift.llm import bpe, linedup, minmax, mixing, quality
from claimsift.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier predicts to be of quality 1.

    It learns from the labels of the documents at hand; without any, all stay.
    Null and empty texts are scored like others, as a passage without words;
    rows that repeat stay or go together, rows without an id are scored as
    well, and an empty table stays empty. Other columns do not count.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(model)(F.col("text").cast("string")) >= 0.5)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that repeat or nearly repeat an earlier one."""
    return linedup.dedup(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, 0.8)."""
    return minmax.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source to its target; documents may repeat or be left out."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document of the mixture: doc_id, n_tokens, ids."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", unique_lines),
    ("minhash near-dedup", one_of_each),
    ("source mixing", mixture),
    ("bpe encoding", token_ids),
]

# The classifier is trained and the tokenizer is a library: no SQL for these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
