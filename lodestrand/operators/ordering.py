"""Row numbers and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut


def numbered(df: DataFrame, order: list[str | Column], name: str = "rn", sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the row's number from 1 in ``order`` (which must be total) and the running sum ``run_c`` of each ``c`` in ``sums``.

    Rows are partitioned by ranges of the order; each range counts on from the totals of the ranges before it, of which there
    are as many as shuffle partitions. The ranges are written before they are numbered, so a lost executor cannot change them.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    totals = sorted(s.groupBy("__p").agg(F.count("*").alias("__n"), *(F.sum(c).alias(c) for c in sums)).collect())
    before: dict[str, dict[int, float]] = {c: {} for c in ("__n", *sums)}
    at = {c: 0 for c in before}
    for t in totals:
        for c in before:
            before[c][t["__p"]] = at[c]
            at[c] += t[c] or 0

    def offset(c: str) -> Column:
        pairs = [F.lit(x) for kv in before[c].items() for x in kv]
        return F.create_map(*pairs)[F.col("__p")] if pairs else F.lit(0)

    w = Window.partitionBy("__p").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return s.select(*df.columns, (F.row_number().over(w) + offset("__n")).alias(name), *((F.sum(c).over(run) + offset(c)).alias(f"run_{c}") for c in sums))
