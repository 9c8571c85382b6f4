"""Queries p7: sentences of the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.sentences import sentence_spans, split_sentences
from lodestrand.operators.shred import latest_version
from lodestrand.session import fan_out, table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_out(latest_version(table(spark, sf_dir, "evidence_chunks"), "evidence_id", "updated_at", "content"))


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their kind: ``evidence_id``, ``start_char``, ``end_char``, ``kind``, ``content``."""
    return split_sentences(_chunks(spark, sf_dir), "evidence_id", "content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence spans: ``evidence_id``, ``start_char``, ``end_char``."""
    return sentence_spans(_chunks(spark, sf_dir), "evidence_id", "content")


def p7_unit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the earlier segmentation's units of each kind, how many have offsets and how many are a sentence of ours."""
    units = table(spark, sf_dir, "evidence_units").where("unit_id is not null").select("unit_id", F.lower(F.coalesce("unit_kind", F.lit("none"))).alias("unit_kind"), F.col("parent_evidence_id").alias("evidence_id"), "start_char", "end_char").dropDuplicates(["unit_id"])
    ours = p7_found(spark, sf_dir).withColumn("same", F.lit(1))
    return units.join(ours, ["evidence_id", "start_char", "end_char"], "left").groupBy("unit_kind").agg(F.count("*").alias("units"), F.count("start_char").alias("with_offsets"), F.count("same").alias("sentences"))


QUERIES = {"p7_found": p7_found, "p7_sentences": p7_sentences, "p7_unit_check": p7_unit_check}
SQL: dict[str, str] = {}
