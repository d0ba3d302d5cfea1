"""The registered queries of the operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import bpe, chains, credentials, factorisation, licences, neardup, packing, permutation, runs, scoring, shards, supervision, whitening


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    return permutation.neighbours(_table(spark, sf, "embeddings"))


def op3_linked_credentials(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.scan_documents(_table(spark, sf, "documents"))


def op4_collinear_chains(spark: SparkSession, sf: str) -> DataFrame:
    return chains.repeated_passages(_table(spark, sf, "documents"))


def op5_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    return supervision.judge_documents(_table(spark, sf, "documents"))


def op6_jump_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.place_documents(_table(spark, sf, "documents"), 16)


def op7_lsh_forest(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.link_documents(_table(spark, sf, "documents"), 85)


def op8_sentence_rules(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_documents(_table(spark, sf, "documents"))


def op9_shortest_pack_first(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_factorisation_machine(spark: SparkSession, sf: str) -> DataFrame:
    return factorisation.score_documents(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_branching_tandems(spark: SparkSession, sf: str) -> DataFrame:
    return runs.detect(_table(spark, sf, "documents"))


def op12_bidiagonal_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings"))


def op13_causal_attention(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_documents(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_permutation_index, op3_linked_credentials, op4_collinear_chains, op5_weak_supervision, op6_jump_shards, op7_lsh_forest, op8_sentence_rules, op9_shortest_pack_first, op10_factorisation_machine, op11_branching_tandems, op12_bidiagonal_whitening, op13_causal_attention)}
ORACLES: dict[str, str] = {"op8_sentence_rules": licences.oracle()}
