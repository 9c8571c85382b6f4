"""Session building, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestrand", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for: UTC, adaptive execution, skew joins and Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage is cut in.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder
    of this machine, as in tests; on any other master that would be read by no other machine, so it is an error.
    """
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="lodestrand-")
    spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage replaced by files in the checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def fan_out(df: DataFrame, per_core: int = 3, *keys: str) -> DataFrame:
    """``df`` in as many tasks as there are shuffle partitions, and at least ``per_core`` a core.

    For stages that compute long on rows that come out of an aggregation: adaptive execution joins small partitions by
    their bytes, which leaves such a stage few tasks. Nothing is executed to find the number. Rows of equal ``keys`` are in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism * per_core, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def spread(df: DataFrame, per_core: int = 3, *keys: str) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core, for stages that compute long on each row.

    ``df`` must be a scan without shuffles. One of many files already has that many splits and stays as it is; only a
    scan of few splits is shuffled, which is then small.
    """
    want = max(df.sparkSession.sparkContext.defaultParallelism, 1) * per_core
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)
