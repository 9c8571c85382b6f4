"""Queries p4: oversized chunks as pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.pieces import SPACE, split_texts
from lodestrand.operators.shred import latest_version
from lodestrand.session import table

LIMIT, OVERLAP = 1200, 120


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evidence_id`` and ``content``, one row per chunk."""
    return latest_version(table(spark, sf_dir, "evidence_chunks"), "evidence_id", "updated_at", "content")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks as pieces in order: ``evidence_id``, ``file_name``, ``position``, ``piece``, ``start_char``, ``end_char``, ``text``."""
    rows = chunks(spark, sf_dir)
    long = split_texts(rows, "evidence_id", "content", LIMIT, OVERLAP).drop("forced")
    whole = rows.where((F.length("content") <= LIMIT) & F.col("content").rlike(f"[^{SPACE}]")).select("evidence_id", F.lit(0).alias("piece"), F.lit(0).alias("start_char"), F.length("content").alias("end_char"), F.col("content").alias("text"))
    where = table(spark, sf_dir, "evidence_chunks").groupBy("evidence_id").agg(F.max(F.struct("updated_at", "file_name", "position")).alias("x")).select("evidence_id", "x.file_name", "x.position")
    return long.unionByName(whole).join(where, "evidence_id").select("evidence_id", "file_name", "position", "piece", "start_char", "end_char", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be cut: ``evidence_id``, ``forced`` (1 where a stretch without a boundary is over the limit)."""
    return split_texts(chunks(spark, sf_dir), "evidence_id", "content", LIMIT, OVERLAP).groupBy("evidence_id").agg(F.max("forced").alias("forced"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
_CLASS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?;:,\x{3002}\x{ff01}\x{ff1f}\x{ff1b}\x{ff1a}\x{ff0c}\x{3001}\x{964}\x{2026}]"
SQL = {
    "p4_found": rf"""
        select evidence_id, cast(max(case when list_max(list_transform(string_split_regex(content, '{_CLASS}'), lambda x: length(x))) > 1200 then 1 else 0 end) as integer) as forced
        from evidence_chunks where length(content) > 1200 and regexp_matches(content, '\S') group by evidence_id""",
}
