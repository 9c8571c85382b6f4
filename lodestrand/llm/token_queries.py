"""Queries p8: token ids of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.tokens import encode
from lodestrand.session import spread, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document: ``doc_id``, ``ids``."""
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters a token of each source and language."""
    sizes = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.substring("lang", 1, 2)).alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    sums = docs.join(sizes, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("tokens"), F.sum("chars").cast("bigint").alias("chars"))
    return sums.withColumn("chars_per_token", F.round(F.try_divide("chars", "tokens"), 4))


QUERIES = {"p8_ids": p8_ids, "p8_source_tokens": p8_source_tokens}
SQL: dict[str, str] = {}
