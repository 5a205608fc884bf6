"""Session helpers: a local session for tests, and cutting lineage safely."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("civicspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    ``spark.checkpoint.dir`` of the session wins.  Where it is unset, a
    temporary folder is taken, but only for a local master: on a cluster an
    executor could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="civicspark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    Executors may be lost afterwards without recomputing what led to ``df``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, on at least as many partitions as there are cores of a single machine.

    A small file is one task however much work its rows are.  Where the scan
    has enough partitions already, as any large table has, or is no plain scan, nothing is
    moved, nor on a cluster, where a scan so small isn't worth a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not df.sparkSession.sparkContext.master.startswith("local["):
        return df
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if "Exchange" in plan or "Join" in plan or "Aggregate" in plan:
        return df
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
