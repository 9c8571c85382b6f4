"""Candidate edges scored and labelled (R*, W07, P33-P36, F19-F27, J14, J16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.operators import scoring as sc
from lodestrand.operators.views import CTE, chunks, edge_rows, edges, units, with_
from lodestrand.plans.texts import any_sql

# SQL of the deduplicated edges with their evidence: the pointed unit's content, else the edge's own text.
_Q = "round(conf + case when coalesce(evidence_text, '') <> '' then 0.1 else 0 end + case when unit_id is not null then 0.1 else 0 end + case when source_chunk_pos is not null and target_chunk_pos is not null then 0.05 else 0 end, 6)"
_ORDER = "quality desc, " + ", ".join(f"{c} desc nulls last" for c in ("evidence_text", "unit_id", "source_text", "target_text", "source_layer", "target_layer", "source_chunk_pos", "target_chunk_pos"))
_BEST = f"best as (select * from (select *, row_number() over (partition by doc, src, rel, dst order by {_ORDER}) as rn from (select *, {_Q} as quality from edges where src is not null and dst is not null)) where rn = 1)"
_EV = "ev as (select b.*, coalesce(u.content, b.evidence_text) as evidence from best b left join units u on u.unit_id = b.unit_id)"
_PRE = f"with {CTE['units']}, {CTE['edges']}, {_BEST}, {_EV}"


def _norm(c: str) -> str:
    return rf"regexp_replace(lower(trim(regexp_replace(coalesce({c}, ''), '\s', ' ', 'g'))), ' +', ' ', 'g')"


def _in(c: str, xs) -> str:
    return f"coalesce({c} in ({', '.join(repr(x) for x in xs)}), false)" if xs else "false"


def _allowed_sql(t, unknown: str, open_target: bool = False) -> str:
    opened = f"when coalesce(upper(target_layer), 'UNK') = 'UNK' then {unknown} " if open_target else ""
    return "case " + opened + " ".join(f"when upper(source_layer) = '{k}' then {_in('upper(target_layer)', v)}" for k, v in t.items()) + f" else {unknown} end"


_FEAT = f"""f0 as (select *, {_norm('evidence')} as t, {_norm('source_text')} as s, {_norm('target_text')} as g from ev),
    f1 as (select *, case when s <> '' then strpos(t, s) - 1 else -1 end as si, case when g <> '' then strpos(t, g) - 1 else -1 end as gi from f0),
    f2 as (select *, si >= 0 and gi >= 0 as shared from f1),
    f as (select *, case when shared then si <= gi end as ordered, case when shared then case when si <= gi then greatest(0, gi - si - length(s)) else greatest(0, si - gi - length(g)) end end as gap,
        {any_sql('t', lx.STRONG_TRIGGERS)} as strong, {any_sql('t', lx.WEAK_TRIGGERS)} as weak, {any_sql('t', lx.NEGATION)} as negated, {any_sql('t', lx.UNCERTAINTY)} as unsure from f2)"""
_LABTOK = r"list_distinct(list_concat(regexp_extract_all({0}, '[a-z0-9_]+'), flatten(list_transform(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda r: case when length(r) <= 4 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end))))"
_OVMIN = "(case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / cast(least(len({a}), len({b})) as double) end)".format(a=_LABTOK.format("s"), b=_LABTOK.format("g"))
_i = lambda c, v: f"case when {c} then {v} else 0 end"
_clamp = lambda x: f"greatest(0.0, least(1.0, {x}))"


def with_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated edges with ``evidence``: the pointed unit's content, else the edge's own text.

    Copies of an edge need no step of their own: the best of its rows is kept. Edges without a pointer join nothing, by keys that
    differ, so that they are not one task's.
    """
    e = sc.dedup_edges(edge_rows(spark, d))
    u = units(spark, d).select(F.col("unit_id").alias("pointed"), F.col("content").alias("unit_content"))
    key = F.coalesce("unit_id", F.hash("doc", "src", "rel", "dst").cast("string"))
    return e.join(u, (key == F.col("pointed")) & F.col("unit_id").isNotNull(), "left").drop("pointed").withColumn("evidence", F.coalesce("unit_content", "evidence_text"))


_KEY = ("doc", "src", "rel", "dst")


def edge_dedup_quality(spark: SparkSession, d: str) -> DataFrame:
    """One edge per document, source, relation and target, the best."""
    return sc.dedup_edges(edges(spark, d)).select(*_KEY, "quality", "evidence_text")


def trivial_edges(spark: SparkSession, d: str) -> DataFrame:
    """Trivial and other edges by relation."""
    e = sc.dedup_edges(edges(spark, d)).withColumn("trivial", sc.is_trivial())
    return e.groupBy("rel").agg(F.count_if("trivial").alias("trivial"), F.count("*").alias("edges"))


def relation_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Edges by given and normalised relation."""
    return edges(spark, d).groupBy("rel", sc.normalize_relation().alias("relation")).agg(F.count("*").alias("n"))


def layer_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Layer pairs, whether they may follow each other, and their distance; a missing layer is UNK."""
    e = edges(spark, d).select(*(F.upper(F.coalesce(c, F.lit("UNK"))).alias(c) for c in ("source_layer", "target_layer")))
    g = e.groupBy("source_layer", "target_layer").agg(F.count("*").alias("n"))
    return g.select("source_layer", "target_layer", "n", sc.transition_allowed(lx.TRANSITIONS, True, True).alias("allowed"), sc.layer_distance().alias("distance"))


def pseudo_label_rules(spark: SparkSession, d: str) -> DataFrame:
    """Evidence features and the single-task decision."""
    return sc.single_label(sc.evidence_features(with_evidence(spark, d))).select(*_KEY, "shared", "gap", "pos_score", "neg_score", "rule", "label")


def multitask_labels(spark: SparkSession, d: str) -> DataFrame:
    """Confidences and labels of the tasks."""
    m = sc.multitask(sc.evidence_features(with_evidence(spark, d)))
    return m.select(*_KEY, *(f"{k}_{x}" for k in ("causal", "enable", "dir", "temporal", "first_src", "first_dst") for x in ("conf", "label")), "sample_weight")


def support_labels(spark: SparkSession, d: str) -> DataFrame:
    """Edges by support source, with their mean confidence."""
    m = sc.support_label(sc.multitask(sc.evidence_features(with_evidence(spark, d))))
    return m.groupBy("support_source", "support_label", "support_mask").agg(F.count("*").alias("n"), F.round(F.avg("causal_conf"), 6).alias("mean_conf"))


def edge_support_gate(spark: SparkSession, d: str) -> DataFrame:
    """Support of the evidence and the baseline score."""
    return sc.support_gate(with_evidence(spark, d)).select(*_KEY, "support", "supported", *(F.round(c, 6).alias(c) for c in ("temporal_score", "direction_score", "first_score")), "p_evidence", "baseline")


def direction_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Edges turned into the likelier direction."""
    m = sc.multitask(sc.evidence_features(with_evidence(spark, d))).withColumns({"dir_prob": F.col("dir_conf"), "src_first": F.col("first_src_conf"), "dst_first": F.col("first_dst_conf")})
    return sc.normalize_direction(m).groupBy("reason", "swapped").agg(F.count("*").alias("n"))


def fused_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fused score of the task confidences, mean and largest by relation."""
    m = sc.multitask(sc.evidence_features(with_evidence(spark, d)))
    s = F.round(sc.fused_score(causal=F.col("causal_conf"), enable=F.col("enable_conf"), dir=F.col("dir_conf"), temp=F.col("temporal_conf"), first=0.7 * F.col("first_src_conf") + 0.3 * F.col("first_dst_conf")), 6)
    return m.groupBy("rel").agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean_score"), F.max(s).alias("top_score"))


def evidence_cascade(spark: SparkSession, d: str) -> DataFrame:
    """How each edge finds its evidence: by unit pointer, by units of its chunk, by the chunk, or not; and how many units."""
    e = sc.dedup_edges(edges(spark, d)).select(*_KEY, "unit_id", "source_chunk_id")
    u = units(spark, d).select(F.col("unit_id").alias("uid"))
    per = units(spark, d).groupBy(F.col("parent_evidence_id").alias("source_chunk_id")).agg(F.least(F.count("*"), F.lit(5)).alias("of_chunk"))
    c = chunks(spark, d).select(F.col("evidence_id").alias("source_chunk_id"), F.lit(1).alias("has_chunk"))
    j = e.join(u, e.unit_id == u.uid, "left").join(per, "source_chunk_id", "left").join(c, "source_chunk_id", "left")
    how = F.when(F.col("uid").isNotNull(), "pointer").when(F.col("has_chunk").isNotNull() & F.col("of_chunk").isNotNull(), "chunk_units").when(F.col("has_chunk").isNotNull(), "chunk").otherwise("none")
    n = F.when(F.col("uid").isNotNull(), 1).when(F.col("has_chunk").isNotNull() & F.col("of_chunk").isNotNull(), F.col("of_chunk")).when(F.col("has_chunk").isNotNull(), 1).otherwise(0)
    return j.select(*_KEY, how.alias("how"), n.cast("bigint").alias("units"))


QUERIES = {f.__name__: f for f in (edge_dedup_quality, trivial_edges, relation_normalized, layer_transitions, pseudo_label_rules, multitask_labels, support_labels, edge_support_gate, direction_normalized, fused_scores, evidence_cascade)}

_CAUSAL = "regexp_replace(rel, '^POTENTIAL_', '') in (" + ", ".join(repr(x) for x in lx.LABEL_WHITELIST) + ")"
_SINGLE = f"""r0 as (select *, {_CAUSAL} as causal_rel, {_allowed_sql(lx.LABEL_TRANSITIONS, 'null')} as allowed from f),
    r1 as (select *, round({_clamp(' + '.join([_i('causal_rel', 0.24), _i('allowed', 0.18), _i('strong', 0.24), _i('shared', 0.18), _i('unit_id is not null', 0.06), _i('conf >= 0.75', '0.10')]) + ' - ' + ' - '.join([_i(_OVMIN + ' >= 0.95', 0.12), _i('gap > 120', '0.10'), _i('abs(target_chunk_pos - source_chunk_pos) > 4', 0.05)]))}, 6) as pos_score,
        round({_clamp(' + '.join([_i('not causal_rel', '0.10'), _i('not allowed', 0.45), _i('negated', '0.30'), _i('unsure and not strong', 0.15)]))}, 6) as neg_score from r0),
    r2 as (select *, causal_rel and coalesce(allowed, true) and shared and not negated and pos_score >= 0.90 as base, (coalesce(not allowed, false) or (negated and shared)) and neg_score >= 0.88 as bad from r1),
    r as (select *, case when base and strong then 'HP_REL_TRIGGER_EVIDENCE' when base and (unit_id is not null or conf >= 0.75) then 'HP_REL_CONF_EVIDENCE' when bad then 'HP_FORBIDDEN_OR_NEGATED' end as rule from r2),
    rl as (select *, case when rule like 'HP_REL%' then 1 when rule is not null then 0 end as label from r)"""
_EXPL = _in("rel", ["HAS_CAUSE", "HASCAUSE", "CAUSE_OF", "CAUSED_BY", "ROOT_CAUSE", "CAUSES", "LEADS_TO", "RESULTS_IN", "TRIGGERS", "INDUCES"])
_SGN = lambda v: f"case when ordered then {v} when not ordered then -{v} else 0 end"
_BOTH = "coalesce(source_layer, '') <> '' and coalesce(target_layer, '') <> ''"
_TASKS = {
    "causal": (f"case when {_EXPL} then greatest(0.90, {{0}}) else {{0}} end".format(_clamp(f"0.15 + {_i('strong', 0.25)} + {_i('shared', '0.20')} + {_i(_in('rel', ['CAUSES', 'LEADS_TO', 'RESULTS_IN', 'TRIGGERS', 'INDUCES']), 0.25)} + {_i(_EXPL, 0.58)} - {_i('unsure', '0.20')}")), 0.60, 0.20),
    "enable": (_clamp(f"0.10 + {_i(any_sql('t', lx.ENABLE_CUES), 0.35)} + {_i(chr(34) + 'rel' + chr(34) + ' = ' + repr('ENABLES'), 0.35)} - {_i('negated', 0.25)}"), 0.78, 0.25),
    "dir": (_clamp(f"0.5 + {_i(any_sql('t', lx.FORWARD_CUES), '0.30')} - {_i(any_sql('t', lx.REVERSE_CUES), '0.30')} + {_SGN(0.10)}"), 0.72, 0.28),
    "temporal": (_clamp(f"0.5 + {_i(any_sql('t', lx.BEFORE_CUES), '0.20')} - {_i(any_sql('t', lx.BEFORE_REVERSE_CUES), '0.20')} + {_SGN(0.15)}"), 0.70, 0.30),
    "first_src": (_clamp(f"0.5 + {_i(any_sql('s', lx.FIRST_CUES), 0.25)} + {_i(_BOTH + ' and ' + _in('upper(source_layer)', ['ROOT', 'CAUSE', 'FACTOR', 'SOURCESTATE', 'SOURCEEVENT']), '0.10')}"), 0.70, 0.30),
    "first_dst": (_clamp(f"0.5 + {_i(any_sql('g', lx.FIRST_CUES), 0.25)} - {_i(_BOTH + ' and ' + _in('upper(target_layer)', ['OUTCOME', 'CONSEQUENCE', 'HARMEVENT']), '0.10')}"), 0.70, 0.30),
}
_MULTI = "m0 as (select *, " + ", ".join(f"round({x}, 6) as {k}_conf" for k, (x, _, _) in _TASKS.items()) + " from f), m1 as (select *, " + ", ".join(f"case when {k}_conf >= {p} then 1 when {k}_conf <= {n} then 0 else -1 end as {k}_label" for k, (_, p, n) in _TASKS.items()) + " from m0), m as (select *, round(coalesce(list_avg(list_filter([" + ", ".join(f"case when {k}_label <> -1 then {k}_conf end" for k in _TASKS) + "], lambda x: x is not null)), 1.0), 6) as sample_weight from m1)"
_GTOK = r"list_distinct(regexp_extract_all(lower({}), '[\x{{4e00}}-\x{{9fff}}a-z0-9_\-]+'))"


def _ovmax(a: str, b: str) -> str:
    x, y = _GTOK.format(a), _GTOK.format(b)
    return f"(case when len({x}) = 0 or len({y}) = 0 then 0.0 else len(list_intersect({x}, {y})) / cast(greatest(len({x}), len({y})) as double) end)"


_LAYERS = ", ".join(repr(x) for x in lx.LAYERS)
_DIST = f"coalesce(greatest(0, nullif(list_position([{_LAYERS}], upper(target_layer)), 0) - nullif(list_position([{_LAYERS}], upper(source_layer)), 0)), 0)"
_GATE = f"""g0 as (select *, lower(coalesce(evidence, '')) as ev1, lower(coalesce(source_text, '')) as ls, lower(coalesce(target_text, '')) as lg from ev),
    g1 as (select *, case when ls <> '' then strpos(ev1, ls) else 0 end as si, case when lg <> '' then strpos(ev1, lg) else 0 end as gi, greatest({_ovmax("ls || ' ' || lg", 'ev1')}, {_ovmax("ls || ' ' || rel || ' ' || lg", 'ev1')}) as overlap from g0),
    g2 as (select *, si > 0 as sh, gi > 0 as th, {any_sql('ev1', lx.TRIGGERS)} as trig, si > 0 and gi > 0 and si <= gi as ord, {_ovmax('ls', 'ev1')} > 0 as hs, {_ovmax('lg', 'ev1')} > 0 as hg from g1),
    g3 as (select *, round(least(overlap, 0.35) + {_i('sh', '0.20')} + {_i('th', '0.20')} + {_i('sh and th', '0.20')} + {_i('trig', 0.25)} + 0.10 + {_i('ord', '0.10')} - {_i(any_sql('ev1', lx.GATE_NEGATIVE), 0.25)}, 6) as raw,
        {_clamp(_i(any_sql('ev1', ['先', '随后', '然后', '之后', 'before', 'after', 'then', 'followed']), 0.4) + ' + ' + _i('hs', 0.3) + ' + ' + _i('hg', 0.3))} as temporal_score,
        {_clamp(_i('ord', 0.55) + ' + ' + _i(any_sql('ev1', ['导致', '引发', 'causes', 'leads to', 'results in']), 0.35) + ' - ' + _i(any_sql('ev1', ['由', '源于', 'caused by', 'due to']), 0.25))} as direction_score,
        {_clamp(_i(any_sql('ev1', ['诱因', '隐患', '先是', '起初', '根本原因', '为后续提供条件', 'root cause']), 0.6) + ' + ' + _i('hs', 0.4))} as first_score from g2),
    gt as (select *, round({_clamp('raw')}, 6) as support, overlap >= 0.18 and sh and th and raw >= 0.55 as supported from g3)"""
_REL = "case when rel in (" + ", ".join(repr(x) for x in lx.RELATION_WHITELIST) + ") then rel " + " ".join(f"when {any_sql('rt', w)} then '{n}'" for n, w in sc.RELATION_ALIASES.items()) + " else rel end"
SQL = {
    "edge_dedup_quality": f"with {CTE['edges']}, {_BEST} select doc, src, rel, dst, quality, evidence_text from best",
    "trivial_edges": f"with {CTE['edges']}, {_BEST}, n as (select *, {_norm('source_text')} as s, {_norm('target_text')} as g from best) select rel, count(*) filter (where src = dst or s = g or {_OVMIN} >= 0.95) as trivial, count(*) as edges from n group by rel",
    "relation_normalized": with_("edges") + f", x as (select rel, lower(rel || ' ' || coalesce(evidence_text, '')) as rt from edges) select rel, {_REL} as relation, count(*) as n from x group by 1, 2",
    "layer_transitions": with_("edges") + f", g as (select coalesce(upper(source_layer), 'UNK') as source_layer, coalesce(upper(target_layer), 'UNK') as target_layer, count(*) as n from edges group by 1, 2) select source_layer, target_layer, n, {_allowed_sql(lx.TRANSITIONS, 'true', True)} as allowed, cast({_DIST} as integer) as distance from g",
    "pseudo_label_rules": f"{_PRE}, {_FEAT}, {_SINGLE} select doc, src, rel, dst, shared, gap, pos_score, neg_score, rule, label from rl",
    "multitask_labels": f"{_PRE}, {_FEAT}, {_MULTI} select doc, src, rel, dst, " + ", ".join(f"{k}_{x}" for k in _TASKS for x in ("conf", "label")) + ", sample_weight from m",
    "support_labels": f"{_PRE}, {_FEAT}, {_MULTI}, z as (select *, case when causal_label = 1 then 'hard' when causal_conf >= 0.55 then 'relaxed' when causal_label = 0 then 'hard_negative' else 'unresolved_abstain' end as support_source from m) select support_source, case when support_source in ('hard', 'relaxed') then 1 else 0 end as support_label, case when support_source = 'unresolved_abstain' then 0 else 1 end as support_mask, count(*) as n, round(avg(causal_conf), 6) as mean_conf from z group by 1, 2, 3",
    "edge_support_gate": f"{_PRE}, {_GATE} select doc, src, rel, dst, support, supported, round(temporal_score, 6) as temporal_score, round(direction_score, 6) as direction_score, round(first_score, 6) as first_score, round(0.4 * support + 0.2 * temporal_score + 0.2 * direction_score + 0.2 * first_score, 6) as p_evidence, case when rel in (" + ", ".join(repr(x) for x in lx.RELATION_WHITELIST) + f") then round(case when {_allowed_sql(lx.TRANSITIONS, 'true', True)} then 0.30 else -0.50 end - 0.05 * greatest({_DIST} - 1, 0) + support + {_i('supported', 0.25)}, 6) else -1.0 end as baseline from gt",
    "direction_normalized": f"{_PRE}, {_FEAT}, {_MULTI}, z as (select *, case when dir_conf <= 0.45 then 'dir_prob_reverse' when dir_conf >= 0.55 then 'dir_prob_forward' when first_dst_conf > first_src_conf then 'dst_first_prob' when first_src_conf > first_dst_conf then 'src_first_prob' else 'layer_order_fallback' end as reason from m) select reason, reason in ('dir_prob_reverse', 'dst_first_prob') or (reason = 'layer_order_fallback' and coalesce(nullif(list_position([{', '.join(repr(x) for x in lx.LAYERS)}], upper(source_layer)), 0), 1000000) > coalesce(nullif(list_position([{', '.join(repr(x) for x in lx.LAYERS)}], upper(target_layer)), 0), 1000000)) as swapped, count(*) as n from z group by 1, 2",
    "fused_scores": f"{_PRE}, {_FEAT}, {_MULTI}, z as (select rel, round(0.45 * causal_conf + 0.15 * enable_conf + 0.10 * dir_conf + 0.10 * temporal_conf + 0.10 * (0.7 * first_src_conf + 0.3 * first_dst_conf), 6) as s from m) select rel, count(*) as n, round(avg(s), 6) as mean_score, max(s) as top_score from z group by rel",
    "evidence_cascade": f"with {CTE['units']}, {CTE['chunks']}, {CTE['edges']}, {_BEST}, p as (select parent_evidence_id as pid, least(count(*), 5) as k from units group by 1), z as (select b.doc, b.src, b.rel, b.dst, u.unit_id as uid, p.k, c.evidence_id as cid from best b left join units u on u.unit_id = b.unit_id left join p on p.pid = b.source_chunk_id left join chunks c on c.evidence_id = b.source_chunk_id) select doc, src, rel, dst, case when uid is not null then 'pointer' when cid is not null and k is not null then 'chunk_units' when cid is not null then 'chunk' else 'none' end as how, cast(case when uid is not null then 1 when cid is not null and k is not null then k when cid is not null then 1 else 0 end as bigint) as units from z",
}
