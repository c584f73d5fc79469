"""The corpus operators' queries for the driver. None has an SQL twin but where ``oracle_sql`` says so."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import scratch_path, table
from .context_mixing import lm_scores
from .conversation_repair import SQL as CONVERSATION_REPAIR_SQL
from .conversation_repair import repaired_conversations
from .decontaminate import contaminated
from .id_files import read_ids, write_ids
from .language_id import language_of
from .lexical_search import SQL as LEXICAL_SEARCH_SQL
from .lexical_search import lexical_search
from .ngram_join import SQL as NGRAM_JOIN_SQL
from .ngram_join import jaccard_components
from .packing import packed_sequences
from .packing import piece_digests as packed_pieces
from .pieces import piece_digests
from .quotations import conversations
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .vectors import SQL as VECTORS_SQL
from .vectors import near_duplicate_vectors


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "id-files")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_ids(spark, out)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_ngram_join, op3_pieces, op4_quotations, op5_context_mixing, op6_language_id, op7_token_counts, op8_decontamination, op9_id_files, op10_vectors, op11_lexical_search, op12_conversation_repair, op13_packing, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    twins = {"op2_ngram_join": NGRAM_JOIN_SQL, "op10_vectors": VECTORS_SQL, "op11_lexical_search": LEXICAL_SEARCH_SQL, "op12_conversation_repair": CONVERSATION_REPAIR_SQL}
    return twins | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
