"""The registered queries of the training-data operators, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


from aerolens.llm import query_alignment, query_conversations, query_exact_dedup, query_langid, query_lines, query_lm_scores, query_mixing, query_neighbours, query_ngram_join, query_packing, query_secrets, query_simhash, query_toxicity  # noqa: E402,F401
