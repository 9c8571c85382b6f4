"""Queries p9: documents in containers of 4,096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.packing import pack
from lodestrand.llm.token_queries import p8_ids

CAPACITY = 4096


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies: ``doc_id``, ``part``, ``start``, ``size``, ``container``."""
    return pack(p8_ids(spark, sf_dir), "doc_id", "ids", CAPACITY)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than a container, that is the ones laid into several: ``doc_id``."""
    return p9_packing(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("parts")).where("parts > 1").select("doc_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of space used."""
    fills = p9_packing(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("fill"))
    return fills.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.round(F.sum("fill") / (F.count("*") * CAPACITY), 6).alias("used"), F.max("fill").alias("fullest"))


QUERIES = {"p9_found": p9_found, "p9_packing": p9_packing, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
