"""Queries p10: documents cut off by field limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.truncation import detect
from lodestrand.session import spread, table


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is not blank with its log-odds of being complete: ``doc_id``, ``lang``, ``log_odds``, ``known``, ``threshold``, ``cut``."""
    return detect(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text breaks off: ``doc_id``."""
    return p10_scores(spark, sf_dir).where("cut").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts: documents, cut ones, their share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    marked = docs.join(p10_found(spark, sf_dir).withColumn("one", F.lit(1)), "doc_id", "left")
    return marked.groupBy("source").agg(F.count("*").alias("docs"), F.count("one").alias("cut_docs"), F.round(F.count("one") / F.count("*"), 6).alias("share"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_sources": p10_sources}
SQL: dict[str, str] = {}
