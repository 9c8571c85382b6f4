"""Base views of the evidence store: one row per key, typed and cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import relation_confidence
from lodestrand.session import table


def latest(df: DataFrame, key: str, stamp: str = "updated_at") -> DataFrame:
    """Of each key the row with the largest stamp; ties go to the largest row. A null key gives no row."""
    rest = [c for c in df.columns if c not in (key, stamp)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(stamp, *rest)).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in df.columns if c != key))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """M7: chunks with content."""
    return latest(table(spark, d, "evidence_chunks"), "evidence_id")


def units(spark: SparkSession, d: str) -> DataFrame:
    """M8: evidence units."""
    return latest(table(spark, d, "evidence_units"), "unit_id")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Causal nodes, one row per id (the one with the largest text)."""
    cols = ["text", "layer", "doc_id", "kg_scope", "kg_id", "canonical_type", "temporal_rank", "module_id", "p_node_first", "role_tags"]
    best = table(spark, d, "causal_nodes").where("node_id is not null").groupBy("node_id").agg(F.max(F.struct(*cols)).alias("x"))
    return best.select("node_id", *(f"x.{c}" for c in cols))


def doc_key() -> Column:
    return F.lower(F.trim("doc_id"))


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Candidate edges as they stand, copies included: cleaned document, upper-case relation (``UNK`` if empty), confidence F12."""
    e = table(spark, d, "candidate_edges")
    unit = F.element_at("rel_props", "evidence_unit_id")
    rel = F.upper(F.trim(F.coalesce("relation_type", F.lit(""))))
    return e.select(
        doc_key().alias("doc"), "file_name", F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), F.when(rel == "", "UNK").otherwise(rel).alias("rel"), "source_text", "target_text", "source_layer", "target_layer",
        F.round(relation_confidence("rel_props"), 6).alias("conf"), unit.alias("unit_id"), "evidence_text", "source_chunk_id", "source_chunk_pos", "target_chunk_id", "target_chunk_pos",
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``edge_rows`` without copies."""
    return edge_rows(spark, d).distinct()


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each multitask sample."""
    return latest(table(spark, d, "pseudo_multitask_labels"), "sample_id")


#: The same views in SQL, as common table expressions.
CTE = {
    "chunks": "chunks as (select * from (select *, row_number() over (partition by evidence_id order by updated_at desc) as rn from evidence_chunks where evidence_id is not null) where rn = 1)",
    "units": "units as (select * from (select *, row_number() over (partition by unit_id order by updated_at desc) as rn from evidence_units where unit_id is not null) where rn = 1)",
    "labels": "labels as (select * from (select *, row_number() over (partition by sample_id order by updated_at desc) as rn from pseudo_multitask_labels where sample_id is not null) where rn = 1)",
    "nodes": "nodes as (select * from (select *, row_number() over (partition by node_id order by text desc nulls last) as rn from causal_nodes where node_id is not null) where rn = 1)",
    "edges": """edges as (select distinct lower(trim(doc_id)) as doc, file_name, source_node_id as src, target_node_id as dst,
        case when upper(trim(coalesce(relation_type, ''))) = '' then 'UNK' else upper(trim(relation_type)) end as rel,
        source_text, target_text, source_layer, target_layer,
        round(case when try_cast(rel_props['confidence'] as double) is null or try_cast(rel_props['confidence'] as double) < 0 then 0.0
             when try_cast(rel_props['confidence'] as double) > 1 then least(1.0, try_cast(rel_props['confidence'] as double) / 100)
             else try_cast(rel_props['confidence'] as double) end, 6) as conf,
        rel_props['evidence_unit_id'] as unit_id, evidence_text, source_chunk_id, source_chunk_pos, target_chunk_id, target_chunk_pos
        from candidate_edges)""",
}


def with_(*names: str) -> str:
    """A WITH clause of the named views."""
    return "with " + ", ".join(CTE[n] for n in names)
