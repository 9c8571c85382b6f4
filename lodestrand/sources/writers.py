"""Writers and exports (K20-K25, T01). A target folder is written as a whole and replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import retrieval_tokens, split_name
from lodestrand.operators.ordering import numbered


def inverted_index(docs: DataFrame) -> DataFrame:
    """Postings ``term``, ``doc_id``, ``tf`` of documents."""
    t = docs.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\x{4e00}-\x{9fff}]|[a-z0-9_]+"), F.lit(0))).alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def graph_export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts and relations with ids from 0 in sorted order, and edges by id with the inverse of each (relation id plus
    the number of relations)."""
    concepts = nodes.select(F.lower("name").alias("concept")).where("concept <> ''").distinct()
    concepts = numbered(concepts, ["concept"], "id").withColumn("id", F.col("id") - 1)
    rels = edges.select("rel").where("rel is not null").distinct().withColumn("rid", F.row_number().over(Window.orderBy("rel")) - 1)
    n = rels.agg(F.count("*").alias("n"))
    a, b = concepts.select(F.col("concept").alias("src"), F.col("id").alias("s")), concepts.select(F.col("concept").alias("dst"), F.col("id").alias("t"))
    e = edges.select(F.lower("src").alias("src"), "rel", F.lower("dst").alias("dst")).join(a, "src").join(b, "dst").join(rels, "rel").join(F.broadcast(n)).distinct()
    both = e.select("rid", "s", "t").unionByName(e.select((F.col("rid") + F.col("n")).cast("int").alias("rid"), F.col("t").alias("s"), F.col("s").alias("t")))
    return concepts, rels, both.distinct()


def write_splits(samples: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Samples by the split of their key, a folder each, and the manifest: samples and positives of each split."""
    s = samples.withColumn("split", split_name(key))
    s.write.mode("overwrite").partitionBy("split").json(path)
    return s.groupBy("split").agg(F.count("*").alias("samples"), F.count_if(F.col("label") == 1).alias("positives"))


def label_package(labels: DataFrame, path: str) -> DataFrame:
    """The label table, its review sheet with empty decision columns, and the manifest of counts by label."""
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    empty = F.lit(None).cast("string")
    labels.select("*", *(empty.alias(c) for c in ("manual_decision", "manual_label", "manual_relation_type", "manual_comment", "reviewer"))).write.mode("overwrite").option("header", True).csv(f"{path}/review")
    manifest = labels.groupBy("label").agg(F.count("*").alias("n"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """Terms of at least ``least`` documents, the most frequent first, with their line number."""
    t = docs.select("doc_id", F.explode(retrieval_tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    return numbered(t, [F.desc("docs"), "term"], "id").withColumn("id", F.col("id") - 1)
