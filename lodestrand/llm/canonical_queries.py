"""Queries p2: industry names to classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.canonical import MAX_ENTRIES, decide_values, map_values
from lodestrand.operators.packed import unpack_fields
from lodestrand.session import table


def class_entries(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """Class names and aliases with their codes; the list of classes does not grow with the data."""
    codes = table(spark, sf_dir, "gbt4754_codes")
    names = codes.select(F.col("class_name").alias("name"), F.col("full_code").alias("code"))
    aliases = unpack_fields(codes, "gbt4754_codes", "full_code", ["aliases"]).select(F.col("val").alias("name"), F.col("rec_id").alias("code"))
    rows = names.unionByName(aliases).where("name is not null and code is not null").distinct().orderBy("name", "code").limit(MAX_ENTRIES + 1).collect()
    return [(r["name"], r["code"]) for r in rows]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each entry: ``entry_id``, ``full_code`` (empty when the name means none)."""
    return map_values(table(spark, sf_dir, "gb6441_industry_map"), "entry_id", "industry_name", class_entries(spark, sf_dir))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that mean no class, why (filler, ambiguous, none), with the number of entries that carry them."""
    entries = decide_values(table(spark, sf_dir, "gb6441_industry_map"), "entry_id", "industry_name", class_entries(spark, sf_dir))
    return entries.where("full_code = ''").groupBy(F.col("value").alias("industry_name"), "why").agg(F.countDistinct("entry_id").alias("entries"))


def p2_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries mean each class."""
    codes = table(spark, sf_dir, "gbt4754_codes").select("full_code", "class_name").dropDuplicates(["full_code"])
    counts = p2_found(spark, sf_dir).groupBy("full_code").agg(F.count("*").alias("entries"))
    return codes.join(counts, "full_code", "left").select("full_code", "class_name", F.coalesce("entries", F.lit(0)).alias("entries"))


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched, "p2_class_counts": p2_class_counts}
SQL: dict[str, str] = {}
