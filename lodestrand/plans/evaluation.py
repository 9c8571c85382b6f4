"""Metrics over the multitask labels and reports over the store (A*, Z*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import relation_confidence
from lodestrand.operators import metrics as mt
from lodestrand.operators.views import edges, labels, units, with_
from lodestrand.session import table


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a causal label as gold and their weight as probability."""
    return labels(spark, d).where("silver_edge_causal in (0, 1) and sample_weight is not null").select("sample_id", F.col("silver_edge_causal").alias("gold"), F.col("sample_weight").alias("prob"), "module_id", F.lower(F.trim("twin_group_id")).alias("twin"))


_J = with_("labels") + ", j as (select sample_id, silver_edge_causal as gold, sample_weight as prob, module_id, lower(trim(twin_group_id)) as twin from labels where silver_edge_causal in (0, 1) and sample_weight is not null)"
_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) as accuracy"
_COUNTS = "count(*) filter (where gold = 1 and prob >= {t}) as tp, count(*) filter (where gold <> 1 and prob >= {t}) as fp, count(*) filter (where gold = 1 and prob < {t}) as fn, count(*) filter (where gold <> 1 and prob < {t}) as tn"


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts, rates and areas of the causal task."""
    r = judged(spark, d)
    return mt.rates(mt.counts(r, [])).join(F.broadcast(mt.areas(r)))


def metric_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Rates by module, missing ones as <NONE>."""
    r = judged(spark, d).withColumn("module", F.when(F.coalesce("module_id", F.lit("")) == "", "<NONE>").otherwise(F.col("module_id")))
    return mt.rates(mt.counts(r, ["module"]))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """F1 by threshold."""
    return mt.sweep(judged(spark, d))


def threshold_best(spark: SparkSession, d: str) -> DataFrame:
    """The tuned threshold."""
    return mt.best_threshold(mt.sweep(judged(spark, d)))


def relation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scores by label of direction against temporal order, shifted so that abstentions are the ignored 0."""
    r = labels(spark, d).select((F.col("silver_causal_dir") + 1).alias("gold"), (F.col("silver_temporal_before") + 1).alias("pred")).where("gold is not null and pred is not null")
    return mt.relation_scores(r)


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rank metrics over twin groups."""
    return mt.grouped_ranking(judged(spark, d).where("twin is not null and twin like 'twin::%'").select(F.col("twin").alias("grp"), "gold", "prob", F.col("sample_id").alias("tie")))


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each task by value, and the weight of positives."""
    tasks = ["silver_edge_causal", "silver_edge_enable", "silver_causal_dir", "silver_temporal_before", "silver_node_first_src", "silver_node_first_dst"]
    t = labels(spark, d).select(F.explode(F.array(*(F.struct(F.lit(x).alias("task"), F.col(x).alias("v")) for x in tasks))).alias("x")).select("x.task", "x.v")
    g = t.groupBy("task").agg(F.count_if(F.col("v") == 1).alias("pos"), F.count_if(F.col("v") == 0).alias("neg"), F.count_if(F.col("v") == -1).alias("abstain"))
    return g.withColumn("pos_weight", F.round(F.greatest(F.lit(1.0), mt.ratio(F.col("neg"), F.col("pos"))), 6))


def kg_quality(spark: SparkSession, d: str) -> DataFrame:
    """Results, nodes and relations of each model, with sums that merge and the mean taken last."""
    r = table(spark, d, "llm_results").dropDuplicates().where("llm is not null")
    g = r.groupBy("llm").agg(F.count("*").alias("results"), F.sum(F.coalesce("node_count", F.lit(0))).cast("bigint").alias("nodes"), F.sum(F.coalesce("relation_count", F.lit(0))).cast("bigint").alias("relations"))
    return g.withColumn("mean_nodes", F.round(F.col("nodes") / F.col("results"), 6))


def edge_quality(spark: SparkSession, d: str) -> DataFrame:
    """Shares of unknown relations and missing evidence by file, with the largest confidence."""
    e = edges(spark, d).where("file_name is not null")
    return e.groupBy("file_name").agg(F.count("*").alias("edges"), F.round(F.avg((F.col("rel") == "UNK").cast("double")), 6).alias("unknown"), F.round(F.avg((F.coalesce("evidence_text", F.lit("")) == "").cast("double")), 6).alias("no_evidence"), F.max("conf").alias("top_conf"))


def unit_kind_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Units by kind, with their mean and deviation of length, and all kinds together."""
    u = units(spark, d).where("content is not null").select(F.coalesce(F.lower("unit_kind"), F.lit("<NONE>")).alias("kind"), F.length("content").alias("n"))
    return u.rollup("kind").agg(F.count("*").alias("units"), F.round(F.avg("n"), 4).alias("mean_len"), F.round(F.stddev_pop("n"), 4).alias("sd_len")).withColumn("kind", F.coalesce("kind", F.lit("<ALL>")))


def confidence_scales(spark: SparkSession, d: str) -> DataFrame:
    """raw confidences by scale and the mean of what they mean."""
    e = table(spark, d, "candidate_edges").select(F.element_at("rel_props", "confidence").try_cast("double").alias("raw"), relation_confidence("rel_props").alias("conf"))
    scale = F.when(F.col("raw").isNull(), "none").when(F.col("raw") > 1, "percent").otherwise("unit")
    return e.groupBy(scale.alias("scale")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 5).alias("mean_conf"))


QUERIES = {f.__name__: f for f in (binary_metrics, metric_breakdown, threshold_sweep, threshold_best, relation_metrics, ranking_metrics, class_balance, kg_quality, edge_quality, unit_kind_rollup, confidence_scales)}
_SWEEP = f"{_J}, g as (select unnest(range(10, 92, 2)) as t), s as (select t, {_COUNTS.format(t='t / 100')} from j, g group by t), sw as (select t / 100 as threshold, tp, fp, fn, tn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from s)"
SQL = {
    "binary_metrics": f"{_J}, c as (select {_COUNTS.format(t='0.5')} from j), b as (select prob, count(*) filter (where gold = 1) as pos, count(*) filter (where gold <> 1) as neg from j group by prob), k as (select *, sum(pos) over w as ctp, sum(neg) over w as cfp from b window w as (order by prob desc rows between unbounded preceding and current row)), a as (select round(sum(neg * (ctp - pos / 2)) / (sum(pos) * sum(neg)), 6) as auroc, round(sum(pos * ctp / (ctp + cfp)) / sum(pos), 6) as aupr from k) select tp, fp, fn, tn, {_RATES}, auroc, aupr from c, a",
    "metric_breakdown": f"{_J}, c as (select case when coalesce(module_id, '') = '' then '<NONE>' else module_id end as module, {_COUNTS.format(t='0.5')} from j group by 1) select module, tp, fp, fn, tn, {_RATES} from c",
    "threshold_sweep": f"{_SWEEP} select * from sw",
    "threshold_best": f"{_SWEEP} select threshold, f1 from sw order by f1 desc, abs(threshold - 0.5) > 1e-9, threshold limit 1",
    "relation_metrics": with_("labels") + ", r as (select silver_causal_dir + 1 as gold, silver_temporal_before + 1 as pred from labels where silver_causal_dir is not null and silver_temporal_before is not null), l as (select unnest([1, 2]) as label), c as (select label, count(*) filter (where gold = label and pred = label) as tp, count(*) filter (where gold <> label and pred = label) as fp, count(*) filter (where gold = label and pred <> label) as fn from r, l group by label) select label, tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c",
    "ranking_metrics": f"{_J}, r as (select twin, gold, row_number() over (partition by twin order by prob desc, sample_id) as rank from j where twin like 'twin::%'), g as (select twin, min(case when gold = 1 and rank <= 5 then rank end) as first, sum(case when gold = 1 and rank <= 5 then 1 / log2(rank + 1) else 0 end) as dcg, count(*) filter (where gold = 1) as pos from r group by twin having count(*) filter (where gold = 1) > 0) select count(*) as groups, round(avg(coalesce(1 / first, 0)), 6) as mrr, round(avg(case when first <= 1 then 1.0 else 0.0 end), 6) as hits_1, round(avg(case when first <= 3 then 1.0 else 0.0 end), 6) as hits_3, round(avg(case when first <= 5 then 1.0 else 0.0 end), 6) as hits_5, round(avg(dcg / list_sum(list_transform(range(1, least(pos, 5) + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg from g",
    "class_balance": with_("labels") + ", t as (" + " union all ".join(f"select '{x}' as task, {x} as v from labels" for x in ["silver_edge_causal", "silver_edge_enable", "silver_causal_dir", "silver_temporal_before", "silver_node_first_src", "silver_node_first_dst"]) + ") select task, count(*) filter (where v = 1) as pos, count(*) filter (where v = 0) as neg, count(*) filter (where v = -1) as abstain, round(greatest(1.0, coalesce(count(*) filter (where v = 0) / nullif(count(*) filter (where v = 1), 0), 0)), 6) as pos_weight from t group by task",
    "kg_quality": "with r as (select distinct * from llm_results where llm is not null) select llm, count(*) as results, sum(coalesce(node_count, 0)) as nodes, sum(coalesce(relation_count, 0)) as relations, round(sum(coalesce(node_count, 0)) / count(*), 6) as mean_nodes from r group by llm",
    "edge_quality": with_("edges") + " select file_name, count(*) as edges, round(avg(case when rel = 'UNK' then 1.0 else 0.0 end), 6) as unknown, round(avg(case when coalesce(evidence_text, '') = '' then 1.0 else 0.0 end), 6) as no_evidence, max(conf) as top_conf from edges where file_name is not null group by file_name",
    "unit_kind_rollup": with_("units") + ", u as (select coalesce(lower(unit_kind), '<NONE>') as kind, length(content) as n from units where content is not null) select coalesce(kind, '<ALL>') as kind, count(*) as units, round(avg(n), 4) as mean_len, round(stddev_pop(n), 4) as sd_len from u group by rollup (kind)",
    "confidence_scales": "with e as (select try_cast(rel_props['confidence'] as double) as raw from candidate_edges) select case when raw is null then 'none' when raw > 1 then 'percent' else 'unit' end as scale, count(*) as n, round(avg(case when raw is null or raw < 0 then 0.0 when raw > 1 then least(1.0, raw / 100) else raw end), 5) as mean_conf from e group by 1",
}
