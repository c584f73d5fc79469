"""A corpus pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of
``documents``. Toxic documents, documents of no language, all but the smallest of each group of near-duplicates
and documents that hold benchmark passages go; the last stage gives the ids of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridwatch.llm.common import stored, table
from gridwatch.llm.decontaminate import without_contaminated
from gridwatch.llm.language_id import without_rejected
from gridwatch.llm.ngram_join import one_of_each
from gridwatch.llm.pieces import encode_pieces
from gridwatch.llm.toxicity import without_toxic

#: No SQL twin: the classifiers and tokenizers can't be stated in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("language_id", language), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
