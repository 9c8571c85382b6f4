"""Scores and labels of candidate edges: evidence features, single and multi-task labels, support gates, fusion.

Every function adds columns to a table of edges with ``source_text``, ``target_text``, ``source_layer``, ``target_layer``,
``rel``, ``conf`` and ``evidence`` (text). Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand import lexicons as lx
from lodestrand.functions.text import clamp01, contains_any, discretize, gate_tokens, normalize, overlap_min


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Of the edges of one document, source, relation and target the one of the best quality.

    Quality is the confidence, .1 for evidence text, .1 for a unit pointer and .05 for both chunk places.
    """
    q = F.col("conf") + F.when(F.coalesce("evidence_text", F.lit("")) != "", 0.1).otherwise(0.0) + F.when(F.col("unit_id").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("source_chunk_pos").isNotNull() & F.col("target_chunk_pos").isNotNull(), 0.05).otherwise(0.0)
    e = edges.where("src is not null and dst is not null").withColumn("quality", F.round(q, 6))
    order = Window.partitionBy("doc", "src", "rel", "dst").orderBy(F.desc("quality"), *(F.col(c).desc_nulls_last() for c in ("evidence_text", "unit_id", "source_text", "target_text", "source_layer", "target_layer", "source_chunk_pos", "target_chunk_pos")))
    return e.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def is_trivial() -> Column:
    """Same node, same surface, or nearly the same words."""
    s, t = normalize("source_text"), normalize("target_text")
    return (F.col("src") == F.col("dst")) | (s == t) | (overlap_min("source_text", "target_text") >= 0.95)


def layer_index(c: str) -> Column:
    """Place of a layer in the order of layers, from 0; null for an unknown one."""
    return F.when(F.array_contains(F.array(*map(F.lit, lx.LAYERS)), F.upper(c)), F.array_position(F.array(*map(F.lit, lx.LAYERS)), F.upper(c)) - 1)


def layer_distance() -> Column:
    """steps from the source's layer to the target's, at least 0; 0 where one is unknown."""
    return F.coalesce(F.greatest(F.lit(0), layer_index("target_layer") - layer_index("source_layer")), F.lit(0)).cast("int")


def transition_allowed(table: dict[str, list[str]], unknown, open_target: bool = False) -> Column:
    """Whether the layers may follow each other; ``unknown`` where the source's layer has no entry, and with
    ``open_target`` also where the target's layer is missing or UNK (the label rules' own table has no such opening)."""
    target = F.upper(F.coalesce("target_layer", F.lit("UNK")))
    out = F.when(F.lit(open_target) & (target == "UNK"), F.lit(unknown))
    for layer, targets in table.items():
        out = out.when(F.upper("source_layer") == layer, target.isin(targets) if targets else F.lit(False))
    return out.otherwise(F.lit(unknown))


def evidence_features(edges: DataFrame) -> DataFrame:
    """Whether the evidence names both ends, with which cues, in which order and how far apart."""
    e = edges.withColumns({"t": normalize("evidence"), "s": normalize("source_text"), "g": normalize("target_text")})
    si, gi = F.when(F.col("s") != "", F.instr("t", F.col("s")) - 1).otherwise(-1), F.when(F.col("g") != "", F.instr("t", F.col("g")) - 1).otherwise(-1)
    e = e.withColumns({"si": si, "gi": gi}).withColumn("shared", (F.col("si") >= 0) & (F.col("gi") >= 0))
    first = F.col("si") <= F.col("gi")
    gap = F.when(first, F.greatest(F.lit(0), F.col("gi") - F.col("si") - F.length("s"))).otherwise(F.greatest(F.lit(0), F.col("si") - F.col("gi") - F.length("g")))
    return e.withColumns({
        "ordered": F.when(F.col("shared"), first),
        "gap": F.when(F.col("shared"), gap),
        "strong": contains_any("t", lx.STRONG_TRIGGERS), "weak": contains_any("t", lx.WEAK_TRIGGERS),
        "negated": contains_any("t", lx.NEGATION), "unsure": contains_any("t", lx.UNCERTAINTY),
    })


def _if(c, v: float) -> Column:
    return F.when(c, v).otherwise(0.0)


def single_label(edges: DataFrame) -> DataFrame:
    """``pos_score``, ``neg_score``, ``rule`` and ``label`` (1, 0 or null) of edges with evidence features."""
    causal = F.regexp_replace("rel", "^POTENTIAL_", "").isin(lx.LABEL_WHITELIST)
    allowed = transition_allowed(lx.LABEL_TRANSITIONS, None)
    pointer = F.col("unit_id").isNotNull()
    dist = F.abs(F.col("target_chunk_pos") - F.col("source_chunk_pos"))
    pos = _if(causal, 0.24) + _if(allowed, 0.18) + _if(F.col("strong"), 0.24) + _if(F.col("shared"), 0.18) + _if(pointer, 0.06) + _if(F.col("conf") >= 0.75, 0.10) - _if(overlap_min("source_text", "target_text") >= 0.95, 0.12) - _if(F.col("gap") > 120, 0.10) - _if(dist > 4, 0.05)
    neg = _if(~causal, 0.10) + _if(~allowed, 0.45) + _if(F.col("negated"), 0.30) + _if(F.col("unsure") & ~F.col("strong"), 0.15)
    e = edges.withColumns({"causal_rel": causal, "allowed": allowed, "pos_score": F.round(clamp01(pos), 6), "neg_score": F.round(clamp01(neg), 6)})
    base = F.col("causal_rel") & F.coalesce("allowed", F.lit(True)) & F.col("shared") & ~F.col("negated") & (F.col("pos_score") >= 0.90)
    negative = (F.coalesce(~F.col("allowed"), F.lit(False)) | (F.col("negated") & F.col("shared"))) & (F.col("neg_score") >= 0.88)
    rule = F.when(base & F.col("strong"), "HP_REL_TRIGGER_EVIDENCE").when(base & (pointer | (F.col("conf") >= 0.75)), "HP_REL_CONF_EVIDENCE").when(negative, "HP_FORBIDDEN_OR_NEGATED")
    return e.withColumn("rule", rule).withColumn("label", F.when(F.col("rule").startswith("HP_REL"), 1).when(F.col("rule").isNotNull(), 0))


def multitask(edges: DataFrame) -> DataFrame:
    """Confidences and labels (1, 0, -1) of five tasks, and the mean confidence of those decided."""
    r, t = F.col("rel"), F.col("t")
    explicit = r.isin("HAS_CAUSE", "HASCAUSE", "CAUSE_OF", "CAUSED_BY", "ROOT_CAUSE", "CAUSES", "LEADS_TO", "RESULTS_IN", "TRIGGERS", "INDUCES")
    causal = clamp01(0.15 + _if(F.col("strong"), 0.25) + _if(F.col("shared"), 0.20) + _if(r.isin("CAUSES", "LEADS_TO", "RESULTS_IN", "TRIGGERS", "INDUCES"), 0.25) + _if(explicit, 0.58) - _if(F.col("unsure"), 0.20))
    causal = F.when(explicit, F.greatest(causal, F.lit(0.90))).otherwise(causal)
    enable = clamp01(0.10 + _if(contains_any(t, lx.ENABLE_CUES), 0.35) + _if(r == "ENABLES", 0.35) - _if(F.col("negated"), 0.25))
    sign = lambda v: _if(F.col("ordered"), v) - _if(~F.col("ordered"), v)
    direction = clamp01(0.5 + _if(contains_any(t, lx.FORWARD_CUES), 0.30) - _if(contains_any(t, lx.REVERSE_CUES), 0.30) + sign(0.10))
    temporal = clamp01(0.5 + _if(contains_any(t, lx.BEFORE_CUES), 0.20) - _if(contains_any(t, lx.BEFORE_REVERSE_CUES), 0.20) + sign(0.15))
    both = (F.coalesce("source_layer", F.lit("")) != "") & (F.coalesce("target_layer", F.lit("")) != "")
    src = clamp01(0.5 + _if(contains_any("s", lx.FIRST_CUES), 0.25) + _if(both & F.upper("source_layer").isin("ROOT", "CAUSE", "FACTOR", "SOURCESTATE", "SOURCEEVENT"), 0.10))
    dst = clamp01(0.5 + _if(contains_any("g", lx.FIRST_CUES), 0.25) - _if(both & F.upper("target_layer").isin("OUTCOME", "CONSEQUENCE", "HARMEVENT"), 0.10))
    tasks = {"causal": (causal, 0.60, 0.20), "enable": (enable, 0.78, 0.25), "dir": (direction, 0.72, 0.28), "temporal": (temporal, 0.70, 0.30), "first_src": (src, 0.70, 0.30), "first_dst": (dst, 0.70, 0.30)}
    e = edges.withColumns({f"{k}_conf": F.round(v, 6) for k, (v, _, _) in tasks.items()})
    e = e.withColumns({f"{k}_label": discretize(f"{k}_conf", p, n) for k, (_, p, n) in tasks.items()})
    decided = [F.when(F.col(f"{k}_label") != -1, F.col(f"{k}_conf")) for k in tasks]
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in decided[1:]), F.when(decided[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in decided[1:]), F.coalesce(decided[0], F.lit(0.0)))
    return e.withColumn("sample_weight", F.round(F.when(count > 0, total / count).otherwise(1.0), 6))


def support_label(edges: DataFrame, relaxed: float = 0.55) -> DataFrame:
    """Strict, relaxed or negative support, or none, from the causal task."""
    source = F.when(F.col("causal_label") == 1, "hard").when(F.col("causal_conf") >= relaxed, "relaxed").when(F.col("causal_label") == 0, "hard_negative").otherwise("unresolved_abstain")
    return edges.withColumn("support_source", source).withColumn("support_label", F.when(F.col("support_source").isin("hard", "relaxed"), 1).otherwise(0)).withColumn("support_mask", F.when(F.col("support_source") == "unresolved_abstain", 0).otherwise(1))


def support_gate(edges: DataFrame) -> DataFrame:
    """Support, temporal, direction and first-cause scores of the evidence, and the baseline score."""
    ev = F.lower(F.coalesce("evidence", F.lit("")))
    s, g = F.lower(F.coalesce("source_text", F.lit(""))), F.lower(F.coalesce("target_text", F.lit("")))
    e = edges.withColumns({"ev": ev, "ls": s, "lg": g})
    si = F.when(F.col("ls") != "", F.instr("ev", F.col("ls"))).otherwise(0)
    gi = F.when(F.col("lg") != "", F.instr("ev", F.col("lg"))).otherwise(0)
    # the tokens of texts joined by spaces are those of each; each text is cut once
    e = e.withColumns({"si": si, "gi": gi, **{f"t_{c}": F.array_distinct(gate_tokens(c)) for c in ("ev", "ls", "lg")}}).withColumn("t_ends", F.array_union("t_ls", "t_lg"))
    e = e.withColumn("t_all", F.array_union("t_ends", gate_tokens("rel"))).withColumns({f"n_{c}": F.size(F.array_intersect(f"t_{c}", "t_ev")) for c in ("ls", "lg", "ends", "all")})
    share = lambda c: F.when(F.col(f"n_{c}") == 0, 0.0).otherwise(F.col(f"n_{c}") / F.greatest(F.size(f"t_{c}"), F.size("t_ev")))
    e = e.withColumn("overlap", F.greatest(share("ends"), share("all")))
    src, tgt = F.col("si") > 0, F.col("gi") > 0
    trigger, ordered = contains_any("ev", lx.TRIGGERS), src & tgt & (F.col("si") <= F.col("gi"))
    raw = F.least(F.col("overlap"), F.lit(0.35)) + _if(src, 0.20) + _if(tgt, 0.20) + _if(src & tgt, 0.20) + _if(trigger, 0.25) + 0.10 + _if(ordered, 0.10) - _if(contains_any("ev", lx.GATE_NEGATIVE), 0.25)
    has_s, has_g = F.col("n_ls") > 0, F.col("n_lg") > 0
    temporal = clamp01(_if(contains_any("ev", ["先", "随后", "然后", "之后", "before", "after", "then", "followed"]), 0.4) + _if(has_s, 0.3) + _if(has_g, 0.3))
    direction = clamp01(_if(ordered, 0.55) + _if(contains_any("ev", ["导致", "引发", "causes", "leads to", "results in"]), 0.35) - _if(contains_any("ev", ["由", "源于", "caused by", "due to"]), 0.25))
    first = clamp01(_if(contains_any("ev", ["诱因", "隐患", "先是", "起初", "根本原因", "为后续提供条件", "root cause"]), 0.6) + _if(has_s, 0.4))
    e = e.withColumns({"raw": F.round(raw, 6), "temporal_score": temporal, "direction_score": direction, "first_score": first})
    e = e.withColumns({"support": F.round(clamp01("raw"), 6), "supported": (F.col("overlap") >= 0.18) & src & tgt & (F.col("raw") >= 0.55)})
    allowed = transition_allowed(lx.TRANSITIONS, True, True)
    base = F.when(allowed, 0.30).otherwise(-0.50) - 0.05 * F.greatest(layer_distance() - 1, F.lit(0)) + F.col("support") + _if(F.col("supported"), 0.25)
    score = F.when(F.col("rel").isin(lx.RELATION_WHITELIST), F.round(base, 6)).otherwise(-1.0)
    return e.withColumns({"p_evidence": F.round(0.4 * F.col("support") + 0.2 * F.col("temporal_score") + 0.2 * F.col("direction_score") + 0.2 * F.col("first_score"), 6), "baseline": score})


def fused_score(w: dict[str, float] = lx.EDGE_WEIGHTS, **p: Column) -> Column:
    """weighted sum of the probabilities, missing ones as 0."""
    out = F.lit(0.0)
    for k, v in p.items():
        out = out + w[k] * F.coalesce(v, F.lit(0.0))
    return out


def normalize_direction(edges: DataFrame, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """Edges turned where the direction probability says so, else by which end is likelier first, else by layer."""
    by_first = F.when(F.col("dst_first") > F.col("src_first"), "dst_first_prob").when(F.col("src_first") > F.col("dst_first"), "src_first_prob").otherwise("layer_order_fallback")
    reason = F.when(F.col("dir_prob") <= low, "dir_prob_reverse").when(F.col("dir_prob") >= high, "dir_prob_forward").otherwise(by_first)
    far = F.lit(10**6)
    e = edges.withColumn("reason", reason)
    swap = F.col("reason").isin("dir_prob_reverse", "dst_first_prob") | ((F.col("reason") == "layer_order_fallback") & (F.coalesce(layer_index("source_layer"), far) > F.coalesce(layer_index("target_layer"), far)))
    return e.withColumn("swapped", swap).withColumns({"from_id": F.when(F.col("swapped"), F.col("dst")).otherwise(F.col("src")), "to_id": F.when(F.col("swapped"), F.col("src")).otherwise(F.col("dst"))})


def normalize_relation(rel: str = "rel", text: str = "evidence_text") -> Column:
    """The relation if it is on the whitelist, else that of the first alias in relation and text, else itself."""
    both = F.lower(F.concat_ws(" ", rel, F.coalesce(text, F.lit(""))))
    out = F.when(F.col(rel).isin(lx.RELATION_WHITELIST), F.col(rel))
    for name, words in RELATION_ALIASES.items():
        out = out.when(contains_any(both, words), name)
    return out.otherwise(F.col(rel))


# Words that stand for a relation.
RELATION_ALIASES = {
    "CAUSES": ["导致", "引发", "引起", "造成", "致使", "cause", "causes", "caused"],
    "LEADS_TO": ["从而", "进而", "继而", "lead to", "leads to", "led to"],
    "RESULTS_IN": ["因此", "结果", "resulting in", "result in", "results in"],
    "TRIGGERS": ["触发", "trigger", "triggers", "triggered"],
    "INDUCES": ["诱发", "induce", "induces", "induced"],
    "ENABLES": ["使得", "促成", "enable", "enables", "enabled"],
    "WORSENS": ["恶化", "worsen", "worsens", "worsened"],
    "PREVENTS": ["防止", "预防", "prevent", "prevents", "prevented"],
    "MITIGATES": ["缓解", "降低", "mitigate", "mitigates", "mitigated"],
    "INHIBITS": ["抑制", "inhibit", "inhibits", "inhibited"],
}


def sample_weight(source: str, confidence: str, status: str, base: dict[str, float]) -> Column:
    """weight by label source, shrunk by confidence (gold excepted), bounded by the review status."""
    w = F.lit(1.0)
    for k, v in base.items():
        w = F.when(F.col(source) == k, v).otherwise(w)
    w = F.when((F.col(source) != "gold_chain") & F.col(confidence).isNotNull(), w * F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.col(confidence)))).otherwise(w)
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s == "edited", F.greatest(w, F.lit(1.0))).when(s == "accepted", F.greatest(w, F.lit(0.95))).when((s == "pending") & F.col(source).startswith("pseudo"), F.least(w, F.lit(0.85))).otherwise(w)
