"""Queries over nested records (p3) and packed fields (p5)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.packed import unpack_fields
from lodestrand.operators.shred import Leaf, assemble, kind_leaf, latest_version, shred
from lodestrand.session import fan_out, table

#: The lists of each nested column.
GROUPS = {
    "causal_chains": ["edges[]", "edges[].evidence[]", "edges[].evidence[].spans[]", "edges[].review.notes[]", "branch.ranking[]"],
    "evidence_chunks": ["layout.sections[]", "layout.sections[].blocks[]", "layout.sections[].blocks[].marks[]"],
    "causal_chain_edges": ["cites[]", "cites[].spans[]", "review.notes[]"],
}
KEYS = {"causal_chains": ("chain_id", "chain_json"), "evidence_chunks": ("evidence_id", "meta_json"), "causal_chain_edges": ("edge_id", "meta_json")}


def records(spark: SparkSession, sf_dir: str, tbl: str) -> DataFrame:
    """One row per record of ``tbl``: its key and the JSON of its latest version."""
    key, body = KEYS[tbl]
    return latest_version(table(spark, sf_dir, tbl), key, "updated_at", body)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object in one of the lists: ``tbl``, ``rec_id``, ``parent_path``, ``path``."""
    parts = []
    for tbl, groups in GROUPS.items():
        leaves = [kind_leaf(g) for g in groups]
        levels = shred(fan_out(records(spark, sf_dir, tbl)), *KEYS[tbl], leaves)
        parts.append(assemble(levels, leaves).where("val = 'object'").select(F.lit(tbl).alias("tbl"), "rec_id", "parent_path", "path"))
    return reduce(DataFrame.unionByName, parts)


def _wide(levels: DataFrame, leaves: dict[str, Leaf]) -> DataFrame:
    """The flat table of one list: one column per leaf of the same repeated ancestor."""
    names = F.create_map(*(F.lit(x) for name, leaf in leaves.items() for x in (leaf.path, name)))
    tagged = assemble(levels, list(leaves.values())).withColumn("field", names[F.col("leaf")])
    return tagged.groupBy("rec_id", "parent_path", "path").agg(*(F.max(F.when(F.col("field") == name, F.col("val"))).alias(name) for name in leaves))


#: The flat table of each list: source, list, and its fields with the leaf each is read from and its type.
FLAT = {
    "p3_chain_edges": ("causal_chains", "edges[]", {"edge_id": ("edge_id", "string"), "relation": ("relation", "string"), "source_id": ("source.id", "string"), "target_id": ("target.id", "string"), "score": ("score", "double")}),
    "p3_chain_evidence": ("causal_chains", "edges[].evidence[]", {"unit_id": ("unit_id", "string"), "quote": ("quote", "string")}),
    "p3_chain_spans": ("causal_chains", "edges[].evidence[].spans[]", {"start": ("start", "int"), "end": ("end", "int")}),
    "p3_chain_notes": ("causal_chains", "edges[].review.notes[]", {"at": ("at", "string"), "txt": ("txt", "string")}),
    "p3_chain_ranking": ("causal_chains", "branch.ranking[]", {"code": ("code", "string"), "score": ("score", "double")}),
    "p3_layout_sections": ("evidence_chunks", "layout.sections[]", {"title": ("title", "string")}),
    "p3_layout_blocks": ("evidence_chunks", "layout.sections[].blocks[]", {"block_id": ("block_id", "string"), "kind": ("kind", "string")}),
    "p3_layout_marks": ("evidence_chunks", "layout.sections[].blocks[].marks[]", {"label": ("label", "string"), "start": ("start", "int"), "end": ("end", "int")}),
    "p3_edge_cites": ("causal_chain_edges", "cites[]", {"unit_id": ("unit_id", "string"), "quote": ("quote", "string")}),
    "p3_edge_cite_spans": ("causal_chain_edges", "cites[].spans[]", {"start": ("start", "int"), "end": ("end", "int")}),
    "p3_edge_notes": ("causal_chain_edges", "review.notes[]", {"at": ("at", "string"), "txt": ("txt", "string")}),
}


def flat_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query of one flat table: ``rec_id``, ``parent_path``, ``path`` and the fields of every object in the list."""
    tbl, group, fields = FLAT[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        leaves = {f: Leaf(f"{group}.{leaf}") for f, (leaf, _) in fields.items()} | {"@": kind_leaf(group)}
        levels = shred(fan_out(records(spark, sf_dir, tbl)), *KEYS[tbl], list(leaves.values()))
        return _wide(levels, leaves).where("`@` = 'object'").select("rec_id", "parent_path", "path", *(F.col(f) if t == "string" else F.col(f).try_cast(t).alias(f) for f, (_, t) in fields.items()))

    return query


p3_chain_edges = flat_table("p3_chain_edges")
p3_chain_spans = flat_table("p3_chain_spans")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed value: ``tbl``, ``rec_id``, ``field``, ``pos``, ``val``."""
    codes = unpack_fields(table(spark, sf_dir, "gbt4754_codes"), "gbt4754_codes", "full_code", ["aliases", "keywords"])
    results = unpack_fields(table(spark, sf_dir, "llm_results"), "llm_results", "result_id", ["nodes", "relations"])
    return codes.unionByName(results)


def p5_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each packed value occurs in each field."""
    return p5_found(spark, sf_dir).groupBy("tbl", "field", "val").agg(F.count("*").alias("n"), F.countDistinct("rec_id").alias("records"))


QUERIES = {"p3_found": p3_found, **{name: flat_table(name) for name in FLAT}, "p5_found": p5_found, "p5_value_counts": p5_value_counts}
SQL: dict[str, str] = {}
