"""Queries of dataset building and context (J15, L*, Q14, R04, V03, W08, C03, C05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators import datasets as ds
from lodestrand.operators import scoring as sc
from lodestrand.operators.views import CTE, edges, labels, nodes, units, with_
from lodestrand.plans.paths import _NORM, _TOK
from lodestrand.plans.scores import _FEAT, _GATE, _MULTI, _OVMIN, _PRE, _SINGLE, with_evidence
from lodestrand.plans.texts import any_sql
from lodestrand import lexicons as lx
from lodestrand.session import cut


def lexical_topk_units(spark: SparkSession, d: str) -> DataFrame:
    """The five units of its file that name an edge's ends best, for each pair of texts of a file."""
    e = edges(spark, d).where("file_name is not null and source_text is not null and target_text is not null").select("file_name", "source_text", "target_text").distinct().withColumn("edge", ds.digest_id("e_", "file_name", "source_text", "target_text"))
    u = units(spark, d).select("unit_id", F.regexp_extract("parent_evidence_id", r"^[^|]*\|[^|]*\|([^|]*)", 1).alias("file_name"), "content")
    top = ds.lexical_units(cut(e), u).groupBy("edge").agg(F.count("*").alias("units"), F.max("score").alias("best"))
    return e.join(top, "edge").select("file_name", "source_text", "target_text", "units", "best")


def label_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Labels of candidate pairs, from samples as gold, else from the single-task rules."""
    g = labels(spark, d).where("silver_edge_causal in (0, 1)").select(F.lower(F.trim("doc_id")).alias("doc"), F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), F.col("silver_edge_causal").alias("label"))
    p = cut(sc.single_label(sc.evidence_features(with_evidence(spark, d))).where("doc is not null").select("doc", "src", "dst", "rel", "label"))
    return ds.resolve_labels(p.drop("label"), g, p)


def pair_subgraphs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes around each sampled pair of a document: how many, and the last by place."""
    p = labels(spark, d).select(F.lower(F.trim("doc_id")).alias("doc"), F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst")).where("doc is not null and src is not null and dst is not null")
    n = ds.pair_subgraph(p, edges(spark, d))
    return n.groupBy("doc", "src", "dst").agg(F.count("*").alias("nodes"), F.max(F.struct("place", "node")).alias("x")).select("doc", "src", "dst", "nodes", F.col("x.node").alias("last_node"))


def relation_inference(spark: SparkSession, d: str) -> DataFrame:
    """Units by the relation their cues mean."""
    return units(spark, d).where("content is not null").groupBy(ds.infer_relation("content").alias("relation")).agg(F.count("*").alias("units"))


def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of all edges between two nodes the evidence of largest support, null where none supports."""
    e = edges(spark, d).where("src is not null and dst is not null").withColumn("evidence", F.col("evidence_text"))
    s = sc.support_gate(e).select("src", "dst", "support", "evidence")
    rn = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("support"), F.col("evidence").asc_nulls_last()))
    return s.withColumn("rn", rn).where("rn = 1").select("src", "dst", "support", F.when(F.col("support") > 0, F.col("evidence")).alias("evidence"))


def graph_context(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most named entities of each document, with their one-step relations as text."""
    e = edges(spark, d).where("doc is not null and src is not null and dst is not null")
    m = e.select("doc", F.col("src").alias("node")).unionByName(e.select("doc", F.col("dst").alias("node")))
    c = m.groupBy("doc", "node").agg(F.count("*").alias("n"))
    top = c.withColumn("rn", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "node"))).where("rn <= 25")
    rels = e.join(top.select("doc", F.col("node").alias("src")), ["doc", "src"], "left_semi").select("doc", F.concat_ws(" ", "src", "rel", "dst").alias("r")).distinct()
    text = rels.groupBy("doc").agg(F.md5(F.array_join(F.sort_array(F.collect_set("r")), "; ")).alias("context"), F.count("*").alias("relations"))
    return top.groupBy("doc").agg(F.count("*").alias("entities")).join(text, "doc", "left").select("doc", "entities", "relations", "context")


def module_votes(spark: SparkSession, d: str) -> DataFrame:
    """The module of each document by the votes of its nodes and samples."""
    n = nodes(spark, d).where("doc_id is not null and module_id is not null").select(F.lower(F.trim("doc_id")).alias("item"), F.col("module_id").alias("code"), F.lit(1.0).alias("weight"))
    s = labels(spark, d).where("doc_id is not null and module_id is not null").select(F.lower(F.trim("doc_id")).alias("item"), F.col("module_id").alias("code"), F.lit(0.5).alias("weight"))
    return ds.weighted_vote(n.unionByName(s))


def fused_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of each document fused from the shares its nodes and its edges give."""
    def share(x):
        c = x.groupBy("item", "code").agg(F.count("*").alias("n"))
        return c.select("item", "code", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("item")), 6).alias("score"))

    a = share(nodes(spark, d).where("doc_id is not null and layer is not null").select(F.lower(F.trim("doc_id")).alias("item"), F.col("layer").alias("code")))
    b = share(edges(spark, d).where("doc is not null and source_layer is not null").select(F.col("doc").alias("item"), F.col("source_layer").alias("code")))
    return ds.fused_decode(a, b)


def twin_groups(spark: SparkSession, d: str) -> DataFrame:
    """Samples and documents of each twin group."""
    t = labels(spark, d).select(F.lower(F.trim("twin_group_id")).alias("twin"), F.lower(F.trim("doc_id")).alias("doc"), "sample_id").where("twin like 'twin::%'")
    return t.groupBy("twin").agg(F.count("*").alias("samples"), F.countDistinct("doc").alias("docs"), F.min("sample_id").alias("first_sample"))


def label_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole label pipeline over all documents at once: trivial edges left out, labels and support by document."""
    e = with_evidence(spark, d).where("doc is not null").where(~sc.is_trivial())
    s = sc.support_label(sc.multitask(sc.single_label(sc.evidence_features(e))))
    return s.groupBy("doc").agg(F.count("*").alias("edges"), F.count_if(F.col("label") == 1).alias("strict"), F.sum("support_label").alias("support"), F.sum("support_mask").alias("masked"))


QUERIES = {f.__name__: f for f in (lexical_topk_units, label_resolution, pair_subgraphs, relation_inference, best_evidence, graph_context, module_votes, fused_layers, twin_groups, label_pipeline)}

_OV = lambda a, b: f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / cast(least(len({a}), len({b})) as double) end)"
_GATE_ALL = _GATE.replace("from ev)", "from (select *, evidence_text as evidence from edges where src is not null and dst is not null))", 1)
SQL = {
    "lexical_topk_units": with_("edges", "units") + rf""", e as (select distinct file_name, source_text, target_text, {_NORM.format('source_text')} as ns, {_NORM.format('target_text')} as nt from edges where file_name is not null and source_text is not null and target_text is not null),
        et as (select *, {_TOK.format('ns')} as a, {_TOK.format('nt')} as b from e), u as (select unit_id, regexp_extract(parent_evidence_id, '^[^|]*\|[^|]*\|([^|]*)', 1) as file_name, content, {_NORM.format('content')} as nc from units where content is not null), ut as (select *, {_TOK.format('nc')} as c from u),
        s as (select file_name, source_text, target_text, unit_id, round(1.2 * {_OV('a', 'c')} + 1.2 * {_OV('b', 'c')} + case when source_text <> '' and contains(lower(content), lower(source_text)) then 0.6 else 0 end + case when target_text <> '' and contains(lower(content), lower(target_text)) then 0.6 else 0 end, 6) as score from et join ut using (file_name)),
        r as (select *, row_number() over (partition by file_name, source_text, target_text order by score desc, unit_id) as rank from s where score > 0.25)
        select file_name, source_text, target_text, count(*) as units, max(score) as best from r where rank <= 5 group by 1, 2, 3""",
    "label_resolution": f"{_PRE}, {CTE['labels']}, {_FEAT}, {_SINGLE}, p as (select doc, src, dst, rel, label from rl where doc is not null), g as (select lower(trim(doc_id)) as doc, source_node_id as src, target_node_id as dst, max(silver_edge_causal) as g from labels where silver_edge_causal in (0, 1) group by 1, 2, 3), x as (select doc, src, dst, rel, max(label) as x from p where label is not null group by 1, 2, 3, 4), o as (select doc, src, dst, max(label) as o from p where label is not null group by 1, 2, 3 having count(*) = 1) select p.doc, p.src, p.dst, p.rel, coalesce(g, x, o) as label, case when g is not null then 'gold' when x is not null then 'pseudo' else 'pair' end as label_source from p left join g using (doc, src, dst) left join x using (doc, src, dst, rel) left join o using (doc, src, dst) where coalesce(g, x, o) is not null",
    "pair_subgraphs": with_("labels", "edges") + ", p as (select distinct lower(trim(doc_id)) as doc, source_node_id as src, target_node_id as dst from labels where doc_id is not null and source_node_id is not null and target_node_id is not null), nr as (select doc, src as a, dst as b from edges where src <> dst and doc is not null union select doc, dst, src from edges where src <> dst and doc is not null), n as (select doc, src, dst, src as node, 0 as o from p union all select doc, src, dst, dst, 1 from p union all select p.doc, src, dst, b, 2 from p join nr on nr.doc = p.doc and (a = src or a = dst)), m as (select doc, src, dst, node, min(o) as o from n group by 1, 2, 3, 4), r as (select *, row_number() over (partition by doc, src, dst order by o, node) - 1 as place from m) select doc, src, dst, count(*) as nodes, arg_max(node, place) as last_node from r where place < 32 group by 1, 2, 3",
    "relation_inference": with_("units") + " select case " + " ".join(f"when {any_sql('lower(content)', c)} then '{n}'" for n, c in lx.CANDIDATE_CUES) + " else 'UNK' end as relation, count(*) as units from units where content is not null group by 1",
    "best_evidence": f"with {CTE['edges']}, {_GATE_ALL}, r as (select src, dst, support, evidence, row_number() over (partition by src, dst order by support desc, evidence nulls last) as k from gt) select src, dst, support, case when support > 0 then evidence end as evidence from r where k = 1",
    "graph_context": with_("edges") + ", e as (select * from edges where doc is not null and src is not null and dst is not null), c as (select doc, node, count(*) as n from (select doc, src as node from e union all select doc, dst from e) group by 1, 2), t as (select * from (select *, row_number() over (partition by doc order by n desc, node) as k from c) where k <= 25), r as (select distinct e.doc, e.src || ' ' || rel || ' ' || dst as r from e join t on t.doc = e.doc and t.node = e.src), x as (select doc, md5(string_agg(r, '; ' order by r)) as context, count(*) as relations from r group by 1) select doc, count(*) as entities, max(relations) as relations, max(context) as context from t left join x using (doc) group by doc",
    "module_votes": with_("nodes", "labels") + ", v as (select lower(trim(doc_id)) as item, module_id as code, 1.0 as w from nodes where doc_id is not null and module_id is not null union all select lower(trim(doc_id)), module_id, 0.5 from labels where doc_id is not null and module_id is not null), s as (select item, code, round(sum(w), 6) as score from v group by 1, 2), r as (select *, row_number() over z as k, lead(score) over z as second from s window z as (partition by item order by score desc, code)) select item, code, score, round(least(1.0, 0.5 + (score - coalesce(second, 0)) / (2 * score)), 6) as confidence from r where k = 1",
    "fused_layers": with_("nodes", "edges") + ", a as (select lower(trim(doc_id)) as item, layer as code, count(*) as n from nodes where doc_id is not null and layer is not null group by 1, 2), b as (select doc as item, source_layer as code, count(*) as n from edges where doc is not null and source_layer is not null group by 1, 2), x as (select item, code, round(n / sum(n) over (partition by item), 6) as s from a), y as (select item, code, round(n / sum(n) over (partition by item), 6) as s from b) select item, code, round(0.55 * coalesce(x.s, 0) + 0.25 * coalesce(y.s, 0) + case when x.s is not null and y.s is not null then 0.2 else 0 end, 6) as score from x full join y using (item, code)",
    "twin_groups": with_("labels") + " select lower(trim(twin_group_id)) as twin, count(*) as samples, count(distinct lower(trim(doc_id))) as docs, min(sample_id) as first_sample from labels where lower(trim(twin_group_id)) like 'twin::%' group by 1",
    "label_pipeline": f"{_PRE}, {_FEAT}, {_SINGLE}, {_MULTI.replace('from f)', f'from rl where doc is not null and not (src = dst or s = g or {_OVMIN} >= 0.95))', 1)} select doc, count(*) as edges, count(*) filter (where label = 1) as strict, sum(case when causal_label = 1 or causal_conf >= 0.55 then 1 else 0 end) as support, sum(case when causal_label = 1 or causal_conf >= 0.55 or causal_label = 0 then 1 else 0 end) as masked from m group by doc",
}
