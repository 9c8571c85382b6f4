"""Priors, branches, severity, chains by penalised search, review samples and risk figures, each rule in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions import text as tx
from lodestrand.operators import chains as ch
from lodestrand.operators import graph
from lodestrand.operators import scoring as sc
from lodestrand.operators.ordering import numbered
from lodestrand.operators.views import CTE, doc_key, edge_rows, nodes, units, with_
from lodestrand.plans.paths import _CE, chain_edges
from lodestrand.plans.scores import _BEST, _FEAT, _GATE, _MULTI, _PRE, _SINGLE, _allowed_sql, _DIST, with_evidence
from lodestrand.session import cut, table

# Layers of harm and of consequences, and words of released energy and of poisoning.
HARM, CONSEQUENCE = ["EVENT", "OUTCOME", "CONSEQUENCE"], ["OUTCOME", "CONSEQUENCE"]
ENERGY, TOXIC = ["爆炸", "爆燃", "火灾", "坍塌"], ["中毒", "窒息", "有毒", "缺氧"]


def document_graph(spark: SparkSession, d: str) -> DataFrame:
    """``doc``, ``src``, ``dst``, ``rel``: the edges of each document, once each.

    A document's edges are in one task, so they are shuffled once for all that is counted by document and node.
    """
    return edge_rows(spark, d).where("doc is not null and src is not null and dst is not null").select("doc", "src", "dst", "rel").repartition("doc").distinct()


def node_priors(spark: SparkSession, d: str) -> DataFrame:
    """For each node of a document how likely it comes first: successors, predecessors, enabling edges, nodes
    downstream that another node of the document reaches too, earliness, first cues in text and role tags, and type.

    A null or unknown document has no rows; a missing rank counts as the middle.
    """
    n = nodes(spark, d).select(doc_key().alias("doc"), "node_id", "text", "canonical_type", "temporal_rank", "role_tags").where("doc is not null")
    e = document_graph(spark, d)
    out = e.groupBy("doc", F.col("src").alias("node_id")).agg(F.count("*").alias("fanout"), F.sum(F.lower("rel").contains("enable").cast("int")).alias("enables"))
    inn = e.groupBy("doc", F.col("dst").alias("node_id")).agg(F.count("*").alias("depth"), F.countDistinct("src").alias("preds"))
    mine = n.select("doc", F.col("node_id").alias("src"))
    shared = graph.shared_below(e, mine, "doc").withColumnRenamed("src", "node_id")
    w = Window.partitionBy("doc")
    n = n.withColumns({"lo": F.min("temporal_rank").over(w), "hi": F.max("temporal_rank").over(w)})
    j = n.join(out, ["doc", "node_id"], "left").join(inn, ["doc", "node_id"], "left").join(shared, ["doc", "node_id"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    early = F.when((F.col("hi") > F.col("lo")) & F.col("temporal_rank").isNotNull(), 1 - (F.col("temporal_rank") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    tags = F.filter(F.coalesce("role_tags", F.array().cast("array<string>")), lambda t: F.lower(t).contains("first") | F.lower(t).contains("upstream") | t.contains("先"))
    cues = F.sort_array(F.array_distinct(F.concat(tags, tx.hits(F.lower(F.coalesce("text", F.lit(""))), lx.NODE_FIRST_CUES))))
    j = j.withColumns({"early": early, "cues": cues, "fanout": z("fanout"), "depth": z("depth"), "enables": z("enables"), "shared": z("shared")})
    p = (
        0.2 + F.when(F.col("fanout") > 0, 0.15).otherwise(0.0) + F.when(F.col("depth") == 0, 0.15).otherwise(0.0) + 0.12 * F.least("enables", F.lit(2)) + 0.10 * F.least("shared", F.lit(3))
        + 0.12 * F.col("early") + 0.10 * F.least(F.size("cues"), F.lit(2)) + 0.06 * F.least(F.lit(1.0), z("preds") / 3.0) + F.when(F.col("canonical_type").isin("SourceState", "SourceEvent"), 0.2).otherwise(0.0)
    )
    return j.select("doc", "node_id", "fanout", "depth", "enables", "shared", F.round("early", 6).alias("early"), "cues", F.round(F.least(F.lit(0.99), p), 6).alias("p_first"))


def node_first_prior(spark: SparkSession, d: str) -> DataFrame:
    """``node_priors`` with the number of cues."""
    return node_priors(spark, d).withColumn("cues", F.size("cues"))


def _branches(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a file that share harm node, consequences and roots as one branch, with its features.

    A chain's enabling probability is the share of its ENABLES edges, and an edge is earlier than it should be where its
    target's layer lies before its source's. A branch has the features of its first chain and the best score.
    """
    e = cut(chain_edges(spark, d))
    files = table(spark, d, "causal_chains").where("chain_id is not null and file_name is not null").groupBy("chain_id").agg(F.max("file_name").alias("file_name"))
    back = (F.coalesce(sc.layer_index("target_layer"), F.lit(99)) < F.coalesce(sc.layer_index("source_layer"), F.lit(0))).cast("int")
    e = e.withColumns({"back": back, "en": (F.coalesce("relation", F.lit("")) == "ENABLES").cast("int")})
    up = F.upper("target_layer")
    g = e.groupBy("chain_id").agg(
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("en"), 6).alias("enable"), F.round(F.avg(1 - F.col("back")), 6).alias("temporal"), F.sum("back").alias("violations"),
        F.sum("en").alias("ens"), F.sum(F.col("en") * F.col("back")).alias("late_ens"), F.max(F.when(up.isin(HARM), F.struct("seq", "edge_id", "target_node_id"))).alias("h"), F.max(F.struct("seq", "edge_id", "target_node_id")).alias("l"),
        F.sort_array(F.collect_set(F.when(up.isin(CONSEQUENCE), F.col("target_node_id")))).alias("cons"), F.collect_set("source_node_id").alias("ss"), F.collect_set("target_node_id").alias("ts"), F.min(F.struct("seq", "edge_id", "source_node_id")).alias("f"),
    )
    loops = graph.cyclic(e.select("chain_id", F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst")), "chain_id").withColumn("cycle", F.lit(1.0))
    heads = F.array_except("ss", "ts")
    roots = F.sort_array(F.when(F.size(heads) > 0, heads).otherwise(F.array("f.source_node_id")))
    g = g.join(files, "chain_id").join(loops, "chain_id", "left").select(
        "file_name", "chain_id", "mean_score", "enable", "temporal", "violations", F.coalesce("cycle", F.lit(0.0)).alias("cycle"), F.coalesce(F.try_divide("late_ens", "ens") >= 0.5, F.lit(False)).cast("double").alias("conflict"),
        F.coalesce("h.target_node_id", "l.target_node_id").alias("harm"), F.when(F.size("cons") > 0, F.col("cons")).otherwise(F.array("l.target_node_id")).alias("cons"), roots.alias("roots"), F.size(F.array_union("ss", "ts")).alias("path"),
    )
    key = F.concat_ws("|", F.coalesce("harm", F.lit("-")), F.array_join("cons", ","), F.array_join("roots", ","))
    feats = ["enable", "temporal", "violations", "cycle", "conflict", "cons", "roots", "path"]
    b = g.groupBy("file_name", key.alias("branch")).agg(F.max("mean_score").alias("mean_score"), F.count("*").alias("chains"), F.min(F.struct("chain_id", *feats)).alias("x")).select("file_name", "branch", "mean_score", "chains", *(f"x.{c}" for c in feats))
    prior = node_priors(spark, d).select(F.col("node_id").alias("root"), "early", F.col("shared").alias("below"), F.col("cues").alias("hits"))
    per = b.select("file_name", "branch", F.explode("roots").alias("root")).join(prior, "root").groupBy("file_name", "branch").agg(F.max("early").alias("early"), F.sum("below").alias("below"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    b = b.join(per, ["file_name", "branch"], "left")
    part = lambda c, n: F.round(F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0)) / n), 6)
    return b.withColumns({"root_rank": part("early", 1.0), "shared": part("below", 5.0), "cues": part("hits", 3.0), "coverage": F.round(F.least(F.lit(1.0), F.size("cons") / F.greatest("path", F.lit(1))), 6)})


def branch_decision(spark: SparkSession, d: str) -> DataFrame:
    """Branches of each file, their probability, rank and the decision."""
    return ch.branch_scores(_branches(spark, d)).select("file_name", "branch", "chains", "root_rank", "shared", "cues", "coverage", "violations", "cycle", "p", "rank", "gap", "fallback")


def severity_rank(spark: SparkSession, d: str) -> DataFrame:
    """Files ranked by 5 x deaths, 3 x serious, light injuries, energy and poisoning in their units.

    A file's counts are the largest its units state; a word without a number counts nothing.
    """
    u = units(spark, d).where("content is not null").select(F.regexp_extract("parent_evidence_id", r"^[^|]*\|[^|]*\|([^|]*)", 1).alias("file_name"), "content")
    words = {"death": "死亡", "serious": "重伤", "light": "轻伤"}

    def stated(w: str):
        a, b = F.regexp_extract("content", rf"{w}\s*(\d+)\s*人", 1), F.regexp_extract("content", rf"(\d+)\s*人{w}", 1)
        return F.coalesce(F.max(F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).try_cast("double")), F.lit(0.0))

    g = u.groupBy("file_name").agg(*(stated(w).alias(k) for k, w in words.items()), *(F.max(tx.contains_any("content", ws).cast("double")).alias(k) for k, ws in (("energy", ENERGY), ("toxicity", TOXIC))))
    g = g.withColumn("severity", 5 * F.col("death") + 3 * F.col("serious") + F.col("light") + F.col("energy") + F.col("toxicity"))
    per = numbered(g.groupBy("severity").agg(F.count("*").alias("n")), [F.desc("severity")], sums=("n",)).select("severity", (F.col("run_n") - F.col("n") + 1).cast("int").alias("rank"))
    return g.join(per, "severity").select("file_name", *words, "energy", "toxicity", "severity", "rank")


def risk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Risk factors (nodes with a canonical type): how many, by severity (largest signal, highest first), by layer, and the
    five of highest severity; ``metric``, ``place``, ``name``, ``value``."""
    n = nodes(spark, d).where("canonical_type is not null").select("node_id", "text", F.coalesce("layer", F.lit("UNK")).alias("layer"))
    top = F.array_max(F.map_values("severity_signals"))
    s = table(spark, d, "causal_nodes").where("node_id is not null").groupBy("node_id").agg(F.max(top).alias("severity"))
    n = n.join(s, "node_id", "left")
    total = n.agg(F.count("*").alias("v")).select(F.lit("total").alias("metric"), F.lit(1).alias("place"), F.lit("").alias("name"), F.col("v").cast("double").alias("value"))
    sev = n.where("severity is not null").groupBy("severity").agg(F.count("*").alias("v"))
    by_sev = sev.select(F.lit("severity").alias("metric"), F.row_number().over(Window.orderBy(F.desc("severity"))).alias("place"), F.format_string("%.1f", "severity").alias("name"), F.col("v").cast("double").alias("value"))
    by_layer = n.groupBy("layer").agg(F.count("*").alias("v")).select(F.lit("layer").alias("metric"), F.row_number().over(Window.orderBy(F.desc("v"), "layer")).alias("place"), F.col("layer").alias("name"), F.col("v").cast("double").alias("value"))
    best = n.where("severity is not null").orderBy(F.desc("severity"), "node_id").limit(5)
    worst = best.select(F.lit("worst").alias("metric"), F.row_number().over(Window.orderBy(F.desc("severity"), "node_id")).alias("place"), F.coalesce("text", "node_id").alias("name"), F.col("severity").alias("value"))
    return total.unionByName(by_sev).unionByName(by_layer).unionByName(worst)


def review_sample(spark: SparkSession, d: str, size: int = 2000, per_doc: int = 200, per_rule: int = 500) -> DataFrame:
    """Up to ``size`` edges for review, round by round over the strata of label, rule and relation, the least confident of
    each first, with at most ``per_doc`` of a document and then ``per_rule`` of a rule (the caps are the feature)."""
    s = sc.multitask(sc.single_label(sc.evidence_features(with_evidence(spark, d)))).select(F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"), F.coalesce("rule", F.lit("none")).alias("rule"), "rel", F.coalesce("doc", F.lit("")).alias("doc"), "src", "dst", "causal_conf")
    tie = ["label", "rule", "rel", "doc", "src", "dst"]
    s = s.withColumn("round", F.row_number().over(Window.partitionBy("label", "rule", "rel").orderBy("causal_conf", "doc", "src", "dst")))
    order = ["round", *tie]
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).where(F.col("k") <= per_doc)
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).where(F.col("k") <= per_rule)
    return s.orderBy(*order).limit(size).select("round", *tie, "causal_conf")


def scored_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges of each document with what the search weighs: task probabilities, support, layers."""
    m = sc.support_gate(sc.multitask(sc.evidence_features(with_evidence(spark, d)))).where("doc is not null")
    p = {"causal": "causal_conf", "enable": "enable_conf", "dir": "dir_conf", "temp": "temporal_conf", "evidence": "p_evidence", "first": "first_src_conf"}
    gain = sum((lx.EDGE_WEIGHTS[k] * F.col(c) for k, c in p.items()), F.lit(0.0))
    apart = 0.15 * F.greatest(sc.layer_distance() - 1, F.lit(0))
    cost = F.when(sc.transition_allowed(lx.TRANSITIONS, True, True), 0.0).otherwise(0.75) + apart + F.when(F.col("supported"), 0.0).otherwise(1.0) + F.when(F.col("dir_conf") < 0.5, 0.40).otherwise(0.0) + F.when(F.col("temporal_conf") < 0.5, 0.40).otherwise(0.0)
    return m.select("doc", "src", "rel", "dst", F.upper(F.coalesce("source_layer", F.lit("UNK"))).alias("a"), F.upper(F.coalesce("target_layer", F.lit("UNK"))).alias("b"), F.round(gain - cost, 6).alias("step"))


def beam_chain_search(spark: SparkSession, d: str) -> DataFrame:
    """The eight best chains of each document by penalised best-first search over all its edges from its roots."""
    return ch.penalised_chains(scored_edges(spark, d)).select("doc", "rank", F.array_join("path", ">").alias("path"), "missing", "score")


QUERIES = {f.__name__: f for f in (node_first_prior, branch_decision, severity_rank, risk_metrics, review_sample, beam_chain_search)}

_sql_list = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"
_any = lambda t, ws: f"(case when len(list_filter({_sql_list(ws)}, lambda w: contains({t}, w))) > 0 then 1.0 else 0.0 end)"
_PRIOR = f"""dg as (select distinct doc, src, dst, rel from best where doc is not null),
    nd as (select *, min(temporal_rank) over (partition by doc) as lo, max(temporal_rank) over (partition by doc) as hi from (select *, lower(trim(doc_id)) as doc from nodes) where doc is not null),
    clo as (select doc, src, dst as node from dg union select c.doc, c.src, g.dst from clo c join dg g on g.doc = c.doc and g.src = c.node),
    dn as (select c.* from clo c join nd on nd.doc = c.doc and nd.node_id = c.src), sh as (select doc, node from dn group by 1, 2 having count(*) > 1),
    sd as (select dn.doc, dn.src as node_id, count(*) as shared from dn join sh on sh.doc = dn.doc and sh.node = dn.node group by 1, 2),
    og as (select doc, src as node_id, count(*) as fanout, sum(case when contains(lower(rel), 'enable') then 1 else 0 end) as enables from dg group by 1, 2), ig as (select doc, dst as node_id, count(*) as depth, count(distinct src) as preds from dg group by 1, 2),
    pj as (select nd.doc, nd.node_id, coalesce(fanout, 0) as fanout, coalesce(depth, 0) as depth, coalesce(enables, 0) as enables, coalesce(shared, 0) as shared, coalesce(preds, 0) as preds, canonical_type,
        case when hi > lo and temporal_rank is not null then 1 - (temporal_rank - lo) / (hi - lo) else 0.5 end as early,
        list_sort(list_distinct(list_concat(list_filter(coalesce(role_tags, []), lambda t: contains(lower(t), 'first') or contains(lower(t), 'upstream') or contains(t, '先')), list_filter({_sql_list(lx.NODE_FIRST_CUES)}, lambda w: contains(lower(coalesce(text, '')), w))))) as cues
        from nd left join og on og.doc = nd.doc and og.node_id = nd.node_id left join ig on ig.doc = nd.doc and ig.node_id = nd.node_id left join sd on sd.doc = nd.doc and sd.node_id = nd.node_id),
    pr as (select *, round(least(0.99, 0.2 + case when fanout > 0 then 0.15 else 0 end + case when depth = 0 then 0.15 else 0 end + 0.12 * least(enables, 2) + 0.10 * least(shared, 3) + 0.12 * early + 0.10 * least(len(cues), 2) + 0.06 * least(1.0, preds / 3.0) + case when canonical_type in ('SourceState', 'SourceEvent') then 0.2 else 0 end), 6) as p_first from pj)"""
_L = ", ".join(repr(x) for x in lx.LAYERS)
_POS = f"coalesce(nullif(list_position([{_L}], upper({{}})), 0) - 1, {{}})"
_COUNT = lambda w: rf"coalesce(max(try_cast(coalesce(nullif(regexp_extract(content, '{w}\s*(\d+)\s*人', 1), ''), nullif(regexp_extract(content, '(\d+)\s*人{w}', 1), '')) as double)), 0.0)"
SQL = {
    "node_first_prior": f"with recursive {CTE['nodes']}, {CTE['edges']}, {_BEST}, {_PRIOR} select doc, node_id, fanout, depth, enables, shared, round(early, 6) as early, len(cues) as cues, p_first from pr",
    "branch_decision": f"""with recursive {CTE['nodes']}, {CTE['edges']}, {_BEST}, {_PRIOR}, {_CE}, f as (select chain_id, max(file_name) as file_name from causal_chains where chain_id is not null and file_name is not null group by 1),
        e as (select *, case when {_POS.format('target_layer', 99)} < {_POS.format('source_layer', 0)} then 1 else 0 end as back, case when coalesce(relation, '') = 'ENABLES' then 1 else 0 end as en from ce),
        cc as (select chain_id, source_node_id as src, target_node_id as node from e union select c.chain_id, c.src, e.target_node_id from cc c join e on e.chain_id = c.chain_id and e.source_node_id = c.node),
        cy as (select distinct chain_id from cc where src = node),
        g as (select chain_id, round(avg(score), 6) as mean_score, round(avg(en), 6) as enable, round(avg(1 - back), 6) as temporal, sum(back) as violations, sum(en) as ens, sum(en * back) as late_ens,
            arg_max(target_node_id, (seq, edge_id)) filter (where upper(target_layer) in ('EVENT', 'OUTCOME', 'CONSEQUENCE')) as h, arg_max(target_node_id, (seq, edge_id)) as l, arg_min(source_node_id, (seq, edge_id)) as f0,
            coalesce(list_sort(list(distinct target_node_id) filter (where upper(target_layer) in ('OUTCOME', 'CONSEQUENCE'))), []) as cons, list(distinct source_node_id) as ss, list(distinct target_node_id) as ts from e group by 1),
        k as (select file_name, g.chain_id, mean_score, enable, temporal, violations, case when cy.chain_id is not null then 1.0 else 0.0 end as cycle, case when ens > 0 and late_ens / ens >= 0.5 then 1.0 else 0.0 end as conflict, coalesce(h, l) as harm, case when len(cons) > 0 then cons else [l] end as cons,
            case when len(list_filter(ss, lambda x: not list_contains(ts, x))) > 0 then list_sort(list_filter(ss, lambda x: not list_contains(ts, x))) else [f0] end as roots, len(list_distinct(list_concat(ss, ts))) as path from g join f using (chain_id) left join cy on cy.chain_id = g.chain_id),
        kb as (select *, coalesce(harm, '-') || '|' || array_to_string(cons, ',') || '|' || array_to_string(roots, ',') as branch from k),
        b0 as (select file_name, branch, max(mean_score) as mean_score, count(*) as chains, arg_min(enable, chain_id) as enable, arg_min(temporal, chain_id) as temporal, arg_min(violations, chain_id) as violations, arg_min(cycle, chain_id) as cycle, arg_min(conflict, chain_id) as conflict, arg_min(cons, chain_id) as cons, arg_min(roots, chain_id) as roots, arg_min(path, chain_id) as path from kb group by 1, 2),
        br as (select file_name, branch, unnest(roots) as root from b0), bp as (select file_name, branch, max(round(early, 6)) as early, sum(shared) as below, len(list_distinct(flatten(list(cues)))) as hits from br join pr on pr.node_id = br.root group by 1, 2),
        b as (select b0.*, round(least(1.0, coalesce(early, 0)), 6) as root_rank, round(least(1.0, coalesce(below, 0) / 5.0), 6) as shared, round(least(1.0, coalesce(hits, 0) / 3.0), 6) as cues, round(least(1.0, len(cons) / greatest(path, 1)), 6) as coverage from b0 left join bp using (file_name, branch)),
        p as (select *, round(1 / (1 + exp(-greatest(-20.0, least(20.0, 0.38 * coalesce(mean_score, 0) + 0.16 * enable + 0.16 * temporal + 0.10 * root_rank + 0.08 * shared + 0.08 * cues + 0.04 * coverage - (0.8 * violations + 1.2 * cycle + 0.6 * conflict))))), 6) as p from b),
        r as (select *, row_number() over w as rank, lead(p) over w as second from p window w as (partition by file_name order by p desc, branch))
        select file_name, branch, chains, root_rank, shared, cues, coverage, violations, cycle, p, cast(rank as integer) as rank, case when rank = 1 then round(p - coalesce(second, 0.0), 6) end as gap, case when rank = 1 then round(p - coalesce(second, 0.0), 6) < 0.15 end as fallback from r""",
    "severity_rank": with_("units") + rf", g as (select regexp_extract(parent_evidence_id, '^[^|]*\|[^|]*\|([^|]*)', 1) as file_name, {_COUNT('死亡')} as death, {_COUNT('重伤')} as serious, {_COUNT('轻伤')} as light, max({_any('content', ENERGY)}) as energy, max({_any('content', TOXIC)}) as toxicity from units where content is not null group by 1), s as (select *, 5 * death + 3 * serious + light + energy + toxicity as severity from g) select *, cast(rank() over (order by severity desc) as integer) as rank from s",
    "risk_metrics": with_("nodes") + """, s as (select node_id, max(list_max(map_values(severity_signals))) as severity from causal_nodes where node_id is not null group by 1),
        n as (select node_id, text, coalesce(layer, 'UNK') as layer, severity from nodes left join s using (node_id) where canonical_type is not null), v as (select severity, count(*) as c from n where severity is not null group by 1), y as (select layer, count(*) as c from n group by 1)
        select 'total' as metric, 1 as place, '' as name, cast(count(*) as double) as value from n union all
        select 'severity', cast(row_number() over (order by severity desc) as integer), printf('%.1f', severity), cast(c as double) from v union all
        select 'layer', cast(row_number() over (order by c desc, layer) as integer), layer, cast(c as double) from y union all
        select * from (select 'worst', cast(row_number() over (order by severity desc, node_id) as integer) as k, coalesce(text, node_id), severity from n where severity is not null) where k <= 5""",
    "review_sample": f"""{_PRE}, {_FEAT}, {_SINGLE}, {_MULTI.replace('from f)', 'from rl)', 1)}, z as (select coalesce(cast(label as varchar), 'none') as label, coalesce(rule, 'none') as rule, rel, coalesce(doc, '') as doc, src, dst, causal_conf from m),
        z1 as (select *, cast(row_number() over (partition by label, rule, rel order by causal_conf, doc, src, dst) as integer) as round from z), z2 as (select *, row_number() over (partition by doc order by round, label, rule, rel, src, dst) as kd from z1), z3 as (select *, row_number() over (partition by rule order by round, label, rel, doc, src, dst) as kr from z2 where kd <= 200)
        select round, label, rule, rel, doc, src, dst, causal_conf from z3 where kr <= 500 order by round, label, rule, rel, doc, src, dst limit 2000""",
}
