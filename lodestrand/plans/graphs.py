"""Graph store and graph queries (K*, J*, Q*, G06-G08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators import graph, store
from lodestrand.operators.views import chunks, edges, labels, nodes, units, with_
from lodestrand.session import table

STRUCT = "PART_OF"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each document: ``doc``, ``node_id``, by either end of its candidate edges."""
    e = edges(spark, d).where("doc is not null")
    return e.select("doc", F.col("src").alias("node_id")).unionByName(e.select("doc", F.col("dst").alias("node_id"))).where("node_id is not null").distinct()


_MENTIONS = "mentions as (select distinct doc, node_id from (select doc, src as node_id from edges union all select doc, dst from edges) where doc is not null and node_id is not null)"


def upsert_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains with the newest content and the oldest creation."""
    c = table(spark, d, "causal_chains").select("chain_id", "file_name", "chain_text", "created_at", "updated_at")
    first, second = c.where("updated_at < '2024-07-01'"), c.where("not coalesce(updated_at < '2024-07-01', false)")
    return store.upsert(first, second, "chain_id", "updated_at").select("chain_id", "created_at", "updated_at")


def sparse_update_docs(spark: SparkSession, d: str) -> DataFrame:
    """Node and chunk counts of files: zero and missing counts leave the old value."""
    c = chunks(spark, d).where("file_name is not null")
    old = c.groupBy("file_name").agg(F.count("*").alias("node_count"), F.max("position").cast("bigint").alias("total_chunks"))
    r = table(spark, d, "llm_results").dropDuplicates().where("file_name is not null").groupBy("file_name").agg(F.max("node_count").cast("bigint").alias("node_count"), F.max("page_number").cast("bigint").alias("total_chunks"))
    return store.sparse_update(old, r, "file_name")


def failure_status(spark: SparkSession, d: str) -> DataFrame:
    """Files whose results all lack nodes fail, or count as cancelled where no relation was reported."""
    r = table(spark, d, "llm_results").dropDuplicates().where("file_name is not null")
    rows = r.groupBy("file_name").agg(F.min(F.coalesce("relation_count", F.lit(0)) == 0).alias("is_cancelled"), F.lit("Completed").alias("status"))
    failed = r.groupBy("file_name").agg(F.min(F.coalesce("node_count", F.lit(0))).alias("n")).where("n <= 1").select("file_name")
    return store.fail(rows, failed, "file_name").groupBy("status").agg(F.count("*").alias("files"))


def latest_sample_labels(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each sample."""
    return labels(spark, d).select("sample_id", "updated_at", F.round("sample_weight", 6).alias("sample_weight"))


def cascade_delete_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that go when all pdf documents go."""
    m = mentions(spark, d)
    return store.cascade_delete(m, m.where("doc like '%.pdf'").select("doc").distinct())


def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes no candidate edge joins to another node, with their document."""
    return graph.orphans(nodes(spark, d), edges(spark, d)).select("node_id", F.lower(F.trim("doc_id")).alias("doc"), "layer")


def detach_delete_unk(spark: SparkSession, d: str) -> DataFrame:
    """Edges left by relation when the nodes of layer UNK go."""
    n = nodes(spark, d)
    _, left = graph.detach_delete(n, edges(spark, d), n.where("layer = 'UNK'"))
    return left.groupBy("rel").agg(F.count("*").alias("edges"))


def key_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Chunk keys that occur more than once."""
    return store.duplicates(table(spark, d, "evidence_chunks"), "evidence_id")


def completed_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a candidate edge and a chunk."""
    e = edges(spark, d).where("doc is not null").select("doc", "file_name").distinct()
    return e.join(chunks(spark, d).select("file_name"), "file_name", "left_semi").select("doc").distinct()


def document_view(spark: SparkSession, d: str) -> DataFrame:
    """The structural edges of files: PART_OF, HAS_EVIDENCE_UNIT and HAS_ENTITY, each once."""
    c = chunks(spark, d).where("file_name is not null")
    part = c.select(F.lit("PART_OF").alias("rel"), F.col("evidence_id").alias("src"), F.col("file_name").alias("dst"))
    unit = units(spark, d).join(c.select(F.col("evidence_id").alias("parent_evidence_id")), "parent_evidence_id", "left_semi").select(F.lit("HAS_EVIDENCE_UNIT").alias("rel"), F.col("parent_evidence_id").alias("src"), F.col("unit_id").alias("dst"))
    e = edges(spark, d)
    ent = e.select(F.col("source_chunk_id").alias("src"), F.col("src").alias("dst")).unionByName(e.select(F.col("target_chunk_id").alias("src"), F.col("dst").alias("dst"))).where("src is not null and dst is not null").distinct()
    ent = ent.join(c.select(F.col("evidence_id").alias("src")), "src", "left_semi").select(F.lit("HAS_ENTITY").alias("rel"), "src", "dst")
    return part.unionByName(unit).unionByName(ent).groupBy("rel").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def entity_view(spark: SparkSession, d: str) -> DataFrame:
    """Entity edges with both ends among known nodes, structural relations left out, by relation."""
    n = nodes(spark, d).select("node_id")
    e = edges(spark, d).where(~F.col("rel").isin("PART_OF", "NEXT_CHUNK", "HAS_ENTITY"))
    both = e.join(n.withColumnRenamed("node_id", "src"), "src", "left_semi").join(n.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return both.groupBy("rel").agg(F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("pairs"))


def k_hop_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Q08: nodes within two steps of the nodes of layer ROOT."""
    seeds = nodes(spark, d).where("layer = 'ROOT'").select(F.col("node_id").alias("node"))
    return graph.k_hop(edges(spark, d).where(~F.col("rel").isin("PART_OF", "NEXT_CHUNK", "HAS_ENTITY")), seeds, 2)


def label_type_listing(spark: SparkSession, d: str) -> DataFrame:
    """Q07: relation types and layers with counts."""
    r = edges(spark, d).groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "name", "n")
    return r.unionByName(nodes(spark, d).where("layer is not null").groupBy(F.col("layer").alias("name")).agg(F.count("*").alias("n")).select(F.lit("layer").alias("kind"), "name", "n"))


def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One text and layer for each node from the ends of edges, the smallest."""
    e = edges(spark, d)
    a = e.select(F.col("src").alias("node_id"), F.col("source_text").alias("t"), F.col("source_layer").alias("l")).unionByName(e.select(F.col("dst").alias("node_id"), F.col("target_text").alias("t"), F.col("target_layer").alias("l")))
    return a.where("node_id is not null").groupBy("node_id").agg(F.min("t").alias("text"), F.min("l").alias("layer"), F.count("*").alias("mentions"))


def root_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each document that cause and are not caused."""
    return graph.roots(edges(spark, d).where("doc is not null"), ["doc"])


def _reach_counts(closed: DataFrame) -> DataFrame:
    return closed.groupBy("doc", F.col("src").alias("node_id")).agg(F.count("*").alias("reach"), F.max((F.col("src") == F.col("node")).cast("int")).alias("cyclic"))


def closure_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reachable nodes of each node in its document, and whether it lies on a cycle, over all edges and any number of steps."""
    return _reach_counts(graph.closure(edges(spark, d).where("doc is not null").select("doc", "src", "dst"), ["doc"]))


def chain_edges_join(spark: SparkSession, d: str) -> DataFrame:
    """Chain headers with their edges: edges, first and last place of each chain."""
    h = table(spark, d, "causal_chains").where("chain_id is not null").select("chain_id", "file_name").distinct()
    e = table(spark, d, "causal_chain_edges").where("edge_id is not null").select("edge_id", "chain_id", "seq").dropDuplicates(["edge_id"])
    return h.join(e, "chain_id").groupBy("chain_id").agg(F.count("*").alias("edges"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each chunk by layer."""
    e = edges(spark, d)
    m = e.select(F.col("source_chunk_id").alias("chunk"), F.col("src").alias("n"), F.col("source_layer").alias("layer")).unionByName(e.select(F.col("target_chunk_id").alias("chunk"), F.col("dst").alias("n"), F.col("target_layer").alias("layer")))
    return m.where("chunk is not null and n is not null").groupBy("chunk", F.coalesce("layer", F.lit("UNK")).alias("layer")).agg(F.countDistinct("n").alias("entities"))


def newest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The fifty chunks of each file that were updated last."""
    c = chunks(spark, d).where("file_name is not null")
    rn = F.row_number().over(Window.partitionBy("file_name").orderBy(F.desc("updated_at"), "evidence_id"))
    return c.select("file_name", "evidence_id", rn.alias("rn")).where("rn <= 50")


QUERIES = {f.__name__: f for f in (upsert_chains, sparse_update_docs, failure_status, latest_sample_labels, cascade_delete_entities, orphan_nodes, detach_delete_unk, key_duplicates, completed_docs, document_view, entity_view, k_hop_subgraph, label_type_listing, node_lookup, root_nodes, closure_counts, chain_edges_join, entity_groups, newest_chunks)}
SQL = {
    "upsert_chains": "select chain_id, min(created_at) as created_at, max(updated_at) as updated_at from causal_chains where chain_id is not null group by chain_id",
    "sparse_update_docs": with_("chunks") + """, o as (select file_name, count(*) as n, max(position) as p from chunks where file_name is not null group by file_name),
        r as (select file_name, max(node_count) as n, max(page_number) as p from (select distinct * from llm_results) where file_name is not null group by file_name)
        select o.file_name, coalesce(nullif(r.n, 0), o.n) as node_count, coalesce(nullif(r.p, 0), o.p) as total_chunks from o left join r using (file_name)""",
    "failure_status": """with r as (select file_name, min(coalesce(relation_count, 0)) = 0 and max(coalesce(relation_count, 0)) = 0 as c, min(coalesce(node_count, 0)) <= 1 as f from (select distinct * from llm_results) where file_name is not null group by file_name)
        select case when f then case when c then 'Cancelled' else 'Failed' end else 'Completed' end as status, count(*) as files from r group by 1""",
    "latest_sample_labels": with_("labels") + " select sample_id, updated_at, round(sample_weight, 6) as sample_weight from labels",
    "cascade_delete_entities": with_("edges") + f", {_MENTIONS} select distinct node_id from mentions where doc like '%.pdf' and node_id not in (select node_id from mentions where doc not like '%.pdf')",
    "orphan_nodes": with_("nodes", "edges") + ", ends as (select src as x from edges where src <> dst union select dst from edges where src <> dst) select node_id, lower(trim(doc_id)) as doc, layer from nodes where node_id not in (select x from ends where x is not null)",
    "detach_delete_unk": with_("nodes", "edges") + ", g as (select node_id from nodes where layer = 'UNK') select rel, count(*) as edges from edges where coalesce(src, '') not in (select node_id from g) and coalesce(dst, '') not in (select node_id from g) group by rel",
    "key_duplicates": "select evidence_id, count(*) as n from evidence_chunks group by evidence_id having count(*) > 1",
    "completed_docs": with_("edges", "chunks") + " select distinct doc from edges where doc is not null and file_name in (select file_name from chunks where file_name is not null)",
    "document_view": with_("chunks", "units", "edges") + """, c as (select * from chunks where file_name is not null),
        v as (select 'PART_OF' as rel, evidence_id as src, file_name as dst from c union all
              select 'HAS_EVIDENCE_UNIT', parent_evidence_id, unit_id from units where parent_evidence_id in (select evidence_id from c) union all
              select 'HAS_ENTITY', s, t from (select source_chunk_id as s, src as t from edges union select target_chunk_id, dst from edges) where t is not null and s in (select evidence_id from c))
        select rel, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from v group by rel""",
    "entity_view": with_("nodes", "edges") + " select rel, count(*) as edges, count(distinct (src, dst)) as pairs from edges where rel not in ('PART_OF', 'NEXT_CHUNK', 'HAS_ENTITY') and src in (select node_id from nodes) and dst in (select node_id from nodes) group by rel",
    "k_hop_subgraph": with_("nodes", "edges") + """, u as (select src as a, dst as b from edges where rel not in ('PART_OF', 'NEXT_CHUNK', 'HAS_ENTITY') and src <> dst union select dst, src from edges where rel not in ('PART_OF', 'NEXT_CHUNK', 'HAS_ENTITY') and src <> dst),
        h0 as (select node_id as node, 0 as hop from nodes where layer = 'ROOT'), h1 as (select b as node, 1 as hop from u join h0 on a = node), h2 as (select b as node, 2 as hop from u join h1 on a = node)
        select node, cast(min(hop) as integer) as hop from (select * from h0 union all select * from h1 union all select * from h2) group by node""",
    "label_type_listing": with_("nodes", "edges") + " select 'relation' as kind, rel as name, count(*) as n from edges group by rel union all select 'layer', layer, count(*) from nodes where layer is not null group by layer",
    "node_lookup": with_("edges") + ", a as (select src as node_id, source_text as t, source_layer as l from edges union all select dst, target_text, target_layer from edges) select node_id, min(t) as text, min(l) as layer, count(*) as mentions from a where node_id is not null group by node_id",
    "root_nodes": with_("edges") + " select distinct doc, src as node from edges e where doc is not null and src is not null and not exists (select 1 from edges f where f.doc = e.doc and f.dst = e.src)",
    "closure_counts": with_("edges").replace("with ", "with recursive ", 1) + """, g as (select distinct doc, src, dst from edges where doc is not null and src is not null and dst is not null),
        r as (select doc, src, dst as node from g union select r.doc, r.src, g.dst from r join g on g.doc = r.doc and g.src = r.node)
        select doc, src as node_id, count(*) as reach, max(case when src = node then 1 else 0 end) as cyclic from r group by doc, src""",
    "chain_edges_join": "with h as (select distinct chain_id, file_name from causal_chains where chain_id is not null), e as (select distinct edge_id, chain_id, seq from causal_chain_edges where edge_id is not null) select chain_id, count(*) as edges, min(seq) as first_seq, max(seq) as last_seq from h join e using (chain_id) group by chain_id",
    "entity_groups": with_("edges") + ", m as (select source_chunk_id as chunk, src as n, source_layer as layer from edges union all select target_chunk_id, dst, target_layer from edges) select chunk, coalesce(layer, 'UNK') as layer, count(distinct n) as entities from m where chunk is not null and n is not null group by 1, 2",
    "newest_chunks": with_("chunks") + " select file_name, evidence_id, r as rn from (select file_name, evidence_id, cast(row_number() over (partition by file_name order by updated_at desc, evidence_id) as integer) as r from chunks where file_name is not null) where r <= 50",
}
