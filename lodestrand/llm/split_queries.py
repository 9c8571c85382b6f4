"""Queries p1: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.splits import clean_group, clean_id, empty_state, update
from lodestrand.session import cut, table

#: Samples made before this day are the first batch of p1_incremental.
FIRST_BATCH_BEFORE = "2024-07-01"


def _doc_key() -> Column:
    """The document of a row; a row without one belongs to the document its scope and file name make up."""
    return F.coalesce(clean_id("doc_id"), clean_id(F.concat_ws("|", "kg_scope", "kg_id", "file_name")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each sample: ``doc_id``, ``group_id``, ``created_at``."""
    rows = table(spark, sf_dir, "pseudo_multitask_labels").where("sample_id is not null")
    best = rows.groupBy("sample_id").agg(F.max(F.struct(F.coalesce("updated_at", F.lit("")).alias("u"), clean_id("doc_id").alias("doc_id"), clean_group("twin_group_id").alias("group_id"), F.col("created_at"))).alias("x"))
    return best.select("x.doc_id", "x.group_id", "x.created_at")


def edge_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of candidate_edges by document: ``doc_id``, ``w``; every row counts, copies too, since each is split."""
    return table(spark, sf_dir, "candidate_edges").groupBy(_doc_key().alias("doc_id")).agg(F.count("*").alias("w"))


def _sample_docs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("w"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component and split: ``doc_id``, ``comp``, ``split``, ``w`` (rows)."""
    rows = samples(spark, sf_dir)
    docs = edge_docs(spark, sf_dir).unionByName(_sample_docs(rows))
    return update(empty_state(spark), docs, rows.select("doc_id", "group_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked documents: ``doc_a``, the smallest of a component, with each other one as ``doc_b``."""
    rows = cut(samples(spark, sf_dir))
    state = update(empty_state(spark), _sample_docs(rows), rows.select("doc_id", "group_id"))
    return state.where("comp <> doc_id").select(F.col("comp").alias("doc_a"), F.col("doc_id").alias("doc_b"))


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component table after two batches; ``first_split`` is the split after the first one."""
    rows = cut(samples(spark, sf_dir))
    early, late = rows.where(F.col("created_at") < FIRST_BATCH_BEFORE), rows.where(~(F.coalesce(F.col("created_at"), F.lit("")) < FIRST_BATCH_BEFORE))
    first = cut(update(empty_state(spark), edge_docs(spark, sf_dir).unionByName(_sample_docs(early)), early.select("doc_id", "group_id")))
    second = update(first, _sample_docs(late), rows.select("doc_id", "group_id"))
    return second.join(first.select("doc_id", F.col("split").alias("first_split")), "doc_id", "left").select("doc_id", "comp", "split", "first_split", "w")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, documents and components of each split."""
    return p1_splits(spark, sf_dir).groupBy("split").agg(F.sum("w").alias("rows"), F.count("*").alias("docs"), F.countDistinct("comp").alias("components"))


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_incremental": p1_incremental, "p1_shares": p1_shares}
SQL = {
    "p1_found": """
        with recursive latest as (
            select sample_id, lower(trim(doc_id, ' \t\n\r')) as doc, lower(trim(twin_group_id, ' \t\n\r')) as g
            from (select *, row_number() over (partition by sample_id order by updated_at desc) as rn from pseudo_multitask_labels where sample_id is not null)
            where rn = 1),
        m as (select distinct doc, g from latest where doc is not null and g is not null and g not in ('', '-', '--', 'nan', 'null', 'none', 'n/a', 'na', 'nil', 'unknown', 'undefined', '?')),
        e as (select distinct a.doc as x, b.doc as y from m a join m b using (g) where a.doc <> b.doc),
        reach as (select x, y from e union select r.x, e.y from reach r join e on r.y = e.x)
        select min(x) as doc_a, y as doc_b from (select x, y from reach) group by y having min(x) < y""",
}
