"""Upserts, sparse updates and deletes as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Newest row per key, but the columns in ``keep`` from the oldest; null keys give no row.

    One aggregation over the union, partly done before the shuffle; of rows with equal stamps the largest wins.
    """
    both = old.unionByName(new).where(F.col(key).isNotNull())
    rest = [c for c in old.columns if c not in (key, stamp, *keep)]
    best = both.groupBy(key).agg(F.max(F.struct(stamp, *rest)).alias("x"), *(F.min(c).alias(c) for c in keep))
    return best.select(*(F.col(c) if c == key or c in keep else F.col(f"x.{c}").alias(c) for c in old.columns))


def sparse_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Fields of ``new`` that are neither null nor zero overwrite; other fields and keys stay."""
    fields = [c for c in new.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in fields))

    def value(c: str):
        v = F.col(f"__{c}")
        if dict(new.dtypes)[c] in ("int", "bigint", "double", "float", "smallint", "tinyint"):
            v = F.when(v != 0, v)
        return F.coalesce(v, F.col(c)).alias(c)

    return old.join(n, key, "left").select(*(value(c) if c in fields else F.col(c) for c in old.columns))


def fail(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Status of the failed keys: Cancelled where the row says it was cancelled, else Failed."""
    f = failed.select(key, F.lit(True).alias("__f"))
    status = F.when(F.col("__f"), F.when(F.col("is_cancelled"), "Cancelled").otherwise("Failed")).otherwise(F.col("status"))
    return rows.join(f, key, "left").withColumn("status", status).drop("__f")


def review(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Review decisions override; only accepted, rejected and edited count."""
    ok = decisions.where(F.lower("manual_decision").isin("accepted", "rejected", "edited")).select(key, F.lower("manual_decision").alias("__d"), F.col("manual_label").alias("__l"))
    return rows.join(ok, key, "left").withColumn("review_status", F.coalesce("__d", "review_status")).withColumn("manual_label", F.coalesce("__l", "manual_label")).drop("__d", "__l")


def effective_label(status: str = "review_status", label: str = "label", manual: str = "manual_label"):
    """Null for rejected, the manual label for edited ones (null without it), else the label."""
    return F.when(F.col(status) == "rejected", None).when(F.col(status) == "edited", F.col(manual)).otherwise(F.col(label))


def cascade_delete(mentions: DataFrame, gone_docs: DataFrame) -> DataFrame:
    """Entities (``node_id``) of deleted documents that no kept document mentions."""
    gone = mentions.join(gone_docs, "doc", "left_semi").select("node_id").distinct()
    kept = mentions.join(gone_docs, "doc", "left_anti").select("node_id").distinct()
    return gone.join(kept, "node_id", "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count; a null key counts as a key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
