"""Row numbers and running sums over ranges against a window over all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from lodestrand.operators.ordering import numbered


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"), (F.col("id") % 5).alias("n"))
    w = Window.orderBy("k")
    want = df.select("k", "n", F.row_number().over(w).alias("rn"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run_n"))
    assert rows(numbered(df, ["k"], sums=("n",))) == rows(want)
    assert numbered(df.limit(0), ["k"]).count() == 0
