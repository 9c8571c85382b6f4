"""Evaluation metrics over tables of gold labels, probabilities and ranks. All rates are 0 where their denominator is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.ordering import numbered


def ratio(a: Column, b: Column) -> Column:
    """``a`` / ``b``, 0 where ``b`` is 0 or null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def counts(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Tp, fp, fn, tn by ``keys`` of rows with ``gold`` (0, 1) and ``prob``."""
    g, p = F.col("gold") == 1, F.col("prob") >= threshold
    cols = [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")]
    return rows.groupBy(*keys).agg(*cols) if keys else rows.agg(*cols)


def rates(c: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of the counts."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6), "accuracy": F.round(ratio(tp + tn, tp + fp + fn + tn), 6)})


def by_probability(rows: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct probability; everything a curve needs, and small: one row per value."""
    return rows.groupBy("prob").agg(F.count_if(F.col("gold") == 1).alias("pos"), F.count_if(F.col("gold") != 1).alias("neg"))


def areas(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision; null unless both classes occur."""
    c = numbered(by_probability(rows), [F.desc("prob")], sums=("pos", "neg")).withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"})
    a = c.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return a.select(F.when(both, F.round(F.col("u") / (F.col("p") * F.col("n")), 6)).alias("auroc"), F.when(both, F.round(F.col("ap") / F.col("p"), 6)).alias("aupr"))


def sweep(rows: DataFrame, low: int = 10, high: int = 90, step: int = 2) -> DataFrame:
    """Counts and F1 at thresholds from .10 to .90; the grid meets the distinct probabilities only."""
    grid = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step)))
    c = by_probability(rows).select("*", grid.alias("t"))
    hit = F.col("prob") >= F.col("t") / 100
    s = c.groupBy("t").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"))
    return rates(s).select((F.col("t") / 100).alias("threshold"), "tp", "fp", "fn", "tn", "f1")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the best F1; .5 before others of the same, then the lowest."""
    return swept.orderBy(F.desc("f1"), F.abs(F.col("threshold") - 0.5) > 1e-9, "threshold").limit(1).select("threshold", "f1")


def relation_scores(rows: DataFrame, ignore: int = 0) -> DataFrame:
    """Tp, fp, fn and F1 of each label but the ignored one, of rows with ``gold`` and ``pred``."""
    each = rows.select(F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label"), "gold", "pred").where(F.col("label") != ignore)
    c = each.groupBy("label").agg(F.count_if((F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label"))).alias("tp"), F.count_if((F.col("gold") != F.col("label")) & (F.col("pred") == F.col("label"))).alias("fp"), F.count_if((F.col("gold") == F.col("label")) & (F.col("pred") != F.col("label"))).alias("fn"))
    return c.withColumn("f1", F.round(ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def grouped_ranking(rows: DataFrame, top: int = 5) -> DataFrame:
    """MRR, hits and nDCG over groups with a positive: rows have ``grp``, ``gold``, ``prob``, ``tie``.

    Hits count within the first ``top`` places, with at most one task per group; groups are samples of one twin, so small.
    """
    w = Window.partitionBy("grp").orderBy(F.desc("prob"), "tie")
    r = rows.withColumn("rank", F.row_number().over(w))
    hit = (F.col("gold") == 1) & (F.col("rank") <= top)
    g = r.groupBy("grp").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count_if(F.col("gold") == 1).alias("pos")).where("pos > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("pos"), F.lit(top)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    at = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hits_{k}")
    return g.agg(F.count("*").alias("groups"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), at(1), at(3), at(5), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"))
