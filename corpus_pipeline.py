"""A training-corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes the rows that the one before it kept and returns a frame; all but the last return the
columns of documents.  Decisions take effect: documents of no known language go, one document
of each group of near duplicates stays (five-word shingles, similarity 0.8), documents with a passage
of any benchmark item go, secrets are replaced in the text, and what is left is packed.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeloom.llm import decontaminate, language, neardup, packing, secrets
from changeloom.llm.frames import cut, table
from changeloom.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model of all of them accepts."""
    return language.keep_known(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates."""
    return neardup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither the language model nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
