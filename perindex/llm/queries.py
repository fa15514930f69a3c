"""Queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from perindex.llm import (
    conversations,
    fill_in_middle,
    language_id,
    license_scan,
    packing,
    pii,
    piece_counts,
    pivot_distance,
    posting_lists,
    prefix_bpe,
    quality_rules,
    simhash,
    turn_repair,
)
from perindex.session import materialize

ROOT = str(Path(__file__).resolve().parents[2])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    # Tasks of a local session import this package from the repository, wherever it was started.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{folder}/{table}.parquet")


@register
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(
        read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1
    )


@register
def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.collapse_and_render(read(spark, folder, "conversations"))


ORACLES["op2_chat_formatting"] = conversations.ORACLE


@register
def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_documents(read(spark, folder, "documents")).drop("detections")


@register
def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_bpe.coded_documents(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return language_id.predict(docs, language_id.fit(docs))


@register
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    stats = materialize(quality_rules.statistics(read(spark, folder, "documents")), "statistics")
    return quality_rules.judge(stats, quality_rules.learn_from(stats, read(spark, folder, "labels")))


@register
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return piece_counts.token_counts(read(spark, folder, "documents"), vocabulary, limit=4096)


@register
def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return posting_lists.search(read(spark, folder, "embeddings"), every=100, k=10)


@register
def op9_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"), distance=4, width=4).drop("label")


@register
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read(spark, folder, "documents"))


@register
def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_distance.search(read(spark, folder, "embeddings"), every=20, k=20, scale=64.0)


ORACLES["op11_exact_top_k"] = pivot_distance.ORACLE


@register
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(read(spark, folder, "documents"))


ORACLES["op12_fill_in_middle"] = fill_in_middle.ORACLE


@register
def op13_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair_damaged(read(spark, folder, "conversations"))


ORACLES["op13_structure_repair"] = turn_repair.ORACLE
