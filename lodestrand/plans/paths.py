"""Chains over stored and candidate edges, and candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions import text as tx
from lodestrand.operators import chains as ch
from lodestrand.operators import scoring as sc
from lodestrand.operators.ordering import numbered
from lodestrand.operators.views import CTE, edges, nodes, units, with_
from lodestrand.plans.scores import _BEST
from lodestrand.session import table


def top(spark: SparkSession, d: str) -> DataFrame:
    return ch.top_edges(sc.dedup_edges(edges(spark, d)))


_TOP = f"""{CTE['edges']}, {_BEST}, te as (select doc, src, dst, max(quality) as score, coalesce(max(case when upper(target_layer) in ('OUTCOME', 'CONSEQUENCE') then 1 when target_layer is not null then 0 end), 0) as stop
    from (select *, row_number() over (partition by doc order by quality desc, src, rel, dst) as k from best where doc is not null and src <> dst) where k <= 20 group by 1, 2, 3)"""


def dfs_chains_depth4(spark: SparkSession, d: str) -> DataFrame:
    """Paths of up to four steps over each document's twenty best edges."""
    return ch.dfs_chains(top(spark, d)).select("doc", F.array_join("path", ">").alias("path"), "hops", "score")


def chain_edges(spark: SparkSession, d: str) -> DataFrame:
    """Stored chain edges once each, with their score and support."""
    e = table(spark, d, "causal_chain_edges").where("edge_id is not null and chain_id is not null")
    cols = ["chain_id", "seq", "source_node_id", "source_layer", "target_node_id", "target_layer", "meta_json"]
    best = e.groupBy("edge_id").agg(F.max(F.struct("updated_at", *cols)).alias("x")).select("edge_id", *(f"x.{c}" for c in cols))
    v = F.try_parse_json("meta_json")
    return best.select("edge_id", *cols[:-1], F.try_variant_get(v, "$.score", "double").alias("score"), F.try_variant_get(v, "$.relation", "string").alias("relation"), F.try_variant_get(v, "$.support_score", "double").alias("support"))


_CE = """ce as (select edge_id, chain_id, seq, source_node_id, source_layer, target_node_id, target_layer, case when json_valid(meta_json) then try_cast(json_extract_string(meta_json, '$.score') as double) end as score,
    case when json_valid(meta_json) then json_extract_string(meta_json, '$.relation') end as relation, case when json_valid(meta_json) then try_cast(json_extract_string(meta_json, '$.support_score') as double) end as support
    from (select *, row_number() over (partition by edge_id order by updated_at desc) as k from causal_chain_edges where edge_id is not null and chain_id is not null) where k = 1)"""


def chain_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of each stored chain its edges, mean score, harm node (the last whose layer is one of harm) and consequences."""
    e = chain_edges(spark, d)
    harm = F.max(F.when(F.upper("target_layer").isin("EVENT", "OUTCOME", "CONSEQUENCE"), F.struct("seq", "target_node_id")))
    last = F.max(F.struct("seq", "target_node_id"))
    g = e.groupBy("chain_id").agg(F.count("*").alias("edges"), F.round(F.avg("score"), 6).alias("mean_score"), harm.alias("h"), last.alias("l"), F.countDistinct(F.when(F.upper("target_layer") == "CONSEQUENCE", F.col("target_node_id"))).alias("consequences"))
    return g.select("chain_id", "edges", "mean_score", F.coalesce("h.target_node_id", "l.target_node_id").alias("harm_node"), "consequences")


def unit_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The units of a chunk that name a node of one of the chunk's candidate edges: ``unit_id``, ``parent``, ``node_id``."""
    e = edges(spark, d)
    m = e.select(F.col("source_chunk_id").alias("parent"), F.col("src").alias("node_id"), F.col("source_text").alias("name")).unionByName(e.select(F.col("target_chunk_id").alias("parent"), F.col("dst").alias("node_id"), F.col("target_text").alias("name"))).where("parent is not null and node_id is not null and name <> ''").distinct()
    u = units(spark, d).where("content is not null").select("unit_id", F.col("parent_evidence_id").alias("parent"), "start_char", "content")
    j = m.join(u, "parent").where(F.lower("content").contains(F.lower("name")) | (tx.overlap_min("name", "content") >= 0.24))
    return j.select("unit_id", "parent", "start_char", "node_id").distinct()


def mention_unit_match(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each unit by name or by word overlap."""
    return unit_mentions(spark, d).groupBy("unit_id").agg(F.count("*").alias("nodes"), F.min("node_id").alias("first_node"))


def adjacent_unit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of neighbouring units of a chunk, the nodes of either and of both (the pairs are their product)."""
    m = unit_mentions(spark, d)
    order = Window.partitionBy("parent").orderBy(F.col("start_char").asc_nulls_last(), "unit_id")
    u = m.groupBy("unit_id", "parent", "start_char").agg(F.sort_array(F.collect_set("node_id")).alias("ns"))
    p = u.select("unit_id", F.lead("unit_id").over(order).alias("next_unit"), "ns", F.lead("ns").over(order).alias("nx")).where("next_unit is not null")
    common = F.size(F.array_intersect("ns", "nx"))
    return p.select("unit_id", "next_unit", F.size("ns").alias("left_nodes"), F.size("nx").alias("right_nodes"), (F.size("ns") * F.size("nx") - common).cast("bigint").alias("pairs"))


def counterfactual_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each edge up to two edges of the same document to the same target from the same layer, with other evidence and like words, the closest."""
    e = sc.dedup_edges(edges(spark, d)).where("doc is not null and evidence_text is not null and source_layer is not null").select("doc", "src", "dst", "rel", "source_layer", "source_text", "evidence_text", "conf")
    a, b = e.alias("a"), e.alias("b")
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.dst") == F.col("b.dst")) & (F.col("a.source_layer") == F.col("b.source_layer"))
    j = a.join(b, on).where((F.col("a.src") != F.col("b.src")) & (F.col("a.evidence_text") != F.col("b.evidence_text"))).select(*(F.col(f"a.{c}").alias(c) for c in ("doc", "src", "dst", "rel")), F.col("b.src").alias("twin_src"), F.col("b.rel").alias("twin_rel"), F.round(tx.overlap_ws("a.source_text", "b.source_text"), 6).alias("overlap"), F.round(F.abs(F.col("a.conf") - F.col("b.conf")), 6).alias("diff"))
    rn = F.row_number().over(Window.partitionBy("doc", "src", "dst", "rel").orderBy("diff", F.desc("overlap"), "twin_src", "twin_rel"))
    return j.withColumn("rn", rn).where("rn <= 2")


QUERIES = {f.__name__: f for f in (dfs_chains_depth4, chain_rows, mention_unit_match, adjacent_unit_pairs, counterfactual_pairs)}
_NORM = r"regexp_replace(lower(trim(regexp_replace(coalesce({}, ''), '\s', ' ', 'g'))), ' +', ' ', 'g')"
_TOK = r"list_distinct(list_concat(regexp_extract_all({0}, '[a-z0-9_]+'), flatten(list_transform(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda r: case when length(r) <= 4 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end))))"
_UM = f"""m as (select distinct parent, node_id, name from (select source_chunk_id as parent, src as node_id, source_text as name from edges union all select target_chunk_id, dst, target_text from edges) where parent is not null and node_id is not null and name <> ''),
    mu as (select unit_id, m.parent, start_char, node_id, name, content, {_TOK.format('tn')} as a, {_TOK.format('tc')} as b from (select *, {_NORM.format('name')} as tn from m) m join (select *, {_NORM.format('content')} as tc from units where content is not null) u on u.parent_evidence_id = m.parent),
    um as (select distinct unit_id, parent, start_char, node_id from mu where contains(lower(content), lower(name)) or (len(a) > 0 and len(b) > 0 and len(list_intersect(a, b)) / cast(least(len(a), len(b)) as double) >= 0.24))"""
_L = ", ".join(repr(x) for x in lx.LAYERS)
_W = r"list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> ''))"
_WS = lambda a, b: f"round(case when len({_W.format(a)}) = 0 or len({_W.format(b)}) = 0 then 0.0 else len(list_intersect({_W.format(a)}, {_W.format(b)})) / cast(len(list_distinct(list_concat({_W.format(a)}, {_W.format(b)}))) as double) end, 6)"
SQL = {
    "dfs_chains_depth4": f"""with recursive {_TOP}, s as (select distinct doc, src from te), rt as (select doc, src from s where (doc, src) not in (select doc, dst from te)),
        st as (select * from rt union all select * from s where doc not in (select doc from rt)),
        p as (select doc, src as last, [src] as path, cast(0.0 as double) as total, 0 as hops, 0 as stop, 1 as more from st
              union all select p.doc, te.dst, list_append(p.path, te.dst), p.total + te.score, p.hops + 1, te.stop, case when exists (select 1 from s where s.doc = te.doc and s.src = te.dst) then 1 else 0 end
              from p join te on te.doc = p.doc and te.src = p.last where p.hops < 4 and p.stop = 0 and p.more = 1 and not list_contains(p.path, te.dst))
        select doc, array_to_string(path, '>') as path, hops, round(total / hops, 6) as score from p where hops > 0 and (hops = 4 or stop = 1 or more = 0)""",
    "chain_rows": f"with {_CE} select chain_id, count(*) as edges, round(avg(score), 6) as mean_score, coalesce(arg_max(target_node_id, (seq, target_node_id)) filter (where upper(target_layer) in ('EVENT', 'OUTCOME', 'CONSEQUENCE')), arg_max(target_node_id, (seq, target_node_id))) as harm_node, count(distinct case when upper(target_layer) = 'CONSEQUENCE' then target_node_id end) as consequences from ce group by chain_id",
    "mention_unit_match": with_("units", "edges") + f", {_UM} select unit_id, count(*) as nodes, min(node_id) as first_node from um group by unit_id",
    "adjacent_unit_pairs": with_("units", "edges") + f", {_UM}, u as (select unit_id, parent, start_char, list_sort(list_distinct(list(node_id))) as ns from um group by 1, 2, 3), p as (select unit_id, lead(unit_id) over w as next_unit, ns, lead(ns) over w as nx from u window w as (partition by parent order by start_char nulls last, unit_id)) select unit_id, next_unit, len(ns) as left_nodes, len(nx) as right_nodes, len(ns) * len(nx) - len(list_intersect(ns, nx)) as pairs from p where next_unit is not null",
    "counterfactual_pairs": f"with {CTE['edges']}, {_BEST}, e as (select * from best where doc is not null and evidence_text is not null and source_layer is not null), j as (select a.doc, a.src, a.dst, a.rel, b.src as twin_src, b.rel as twin_rel, {_WS('a.source_text', 'b.source_text')} as overlap, round(abs(a.conf - b.conf), 6) as diff from e a join e b on a.doc = b.doc and a.dst = b.dst and a.source_layer = b.source_layer where a.src <> b.src and a.evidence_text <> b.evidence_text) select * from (select *, cast(row_number() over (partition by doc, src, dst, rel order by diff, overlap desc, twin_src, twin_rel) as integer) as rn from j) where rn <= 2",
}
