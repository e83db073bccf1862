"""A corpus pipeline over the table `documents`: quality, language, near duplicates, mixing, token ids.

Each stage works on all rows that the stage before it kept; all but the last return the columns of documents. Stages
write nothing themselves but intermediates: run() writes each result as Parquet to the shared folder, reads it again, and removes what
the stage wrote on its way.

Defined results: a null text, or one without a letter, goes at the language stage, as does a text in no learned language; of each class of near
duplicates the row of the smallest doc_id stays, rows without one last, and rows that agree in id and text are one; an empty
table stays empty; extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokeline.llm import bpe, jaccard, language, mixing, quality
from spokeline.llm.common import remove_written, written, written_since
from spokeline.llm.queries import table, vocabulary_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return language.keep(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.draw(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them."""
    return bpe.encode(docs, vocabulary_path(), digest=True)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", distinct_documents),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]

#: Trained models and hashed draws are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        mark = len(written_since())
        docs = written(stage(spark, docs, sf_dir))
        made = written_since(mark)
        remove_written(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
