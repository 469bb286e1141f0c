"""Queries p6 to p8 over the mail archive and the evaluation items, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forkline.llm import leaks, lookalike, tokens
from forkline.sources import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts back from their ids."""
    return tokens.token_texts(tokens.token_ids(table(spark, folder, "documents")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, folder, "documents"))


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical_members(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_texts, p7_found, p8_found, p8_canonical)}

#: p6_ids, p7 and p8 have no SQL that ends on whole tables: their tests hold them against brute force and libraries.
SQL: dict[str, str] = {"p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
