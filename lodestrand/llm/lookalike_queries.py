"""Queries p6: texts that look alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.lookalike import alike_groups, alike_pairs, forms
from lodestrand.session import cut, spread, table

SOURCES = {"causal_nodes": ("node_id", "text"), "evidence_units": ("unit_id", "content")}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that read the same and are not the same characters: ``key_a``, ``key_b``."""
    parts = [alike_pairs(spread(table(spark, sf_dir, t).select(k, c)), k, c) for t, (k, c) in SOURCES.items()]
    return parts[0].unionByName(parts[1])


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of forms that unlike texts share, one row each: ``tbl``, ``representative`` (the form's smallest key), ``key``, ``spellings``."""
    parts = []
    for t, (k, c) in SOURCES.items():
        rows = alike_groups(spread(table(spark, sf_dir, t).select(k, c)), k, c)
        named = rows.groupBy("f").agg(F.min("key").alias("representative"), F.countDistinct("t").alias("spellings"))
        parts.append(rows.join(named, "f").select(F.lit(t).alias("tbl"), "representative", "key", "spellings").distinct())
    return parts[0].unionByName(parts[1])


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of every row: ``tbl``, ``key``, ``form`` (null for a null text)."""
    parts = []
    for t, (k, c) in SOURCES.items():
        rows = table(spark, sf_dir, t).select(F.col(k).alias("key"), F.col(c).alias("text")).distinct()
        form = forms(rows, "text")
        parts.append(rows.join(form, "text", "left").select(F.lit(t).alias("tbl"), "key", "form"))
    return parts[0].unionByName(parts[1])


def p6_changed_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table are not in their one form."""
    parts = []
    for t, (k, c) in SOURCES.items():
        rows = table(spark, sf_dir, t).select(F.col(k).alias("key"), F.col(c).alias("text")).where("text is not null").distinct()
        changed = cut(forms(rows, "text")).where("form <> text").select("text")
        parts.append(rows.join(changed, "text", "left_semi").agg(F.lit(t).alias("tbl"), F.count("*").alias("changed")))
    return parts[0].unionByName(parts[1])


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes, "p6_forms": p6_forms, "p6_changed_characters": p6_changed_characters}
SQL: dict[str, str] = {}
