"""Session settings and the shared folder for tables that cut a lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: A table of so many rows, each of bounded width, may be sent to every executor.
BROADCAST_ROWS = 100_000


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session as the tests and the bench use it; a cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(master).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def written(df: DataFrame) -> DataFrame:
    """The table, written once to the shared checkpoint folder and read from there.

    The folder is the one the cluster names in spark.checkpoint.dir. Where none is
    named, a local session, as in tests, gets one of its own; a cluster whose
    executors may not share this machine's folders is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="scoreloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The table over at least as many partitions as there are cores.

    For work that costs far more than moving its rows, on tables that lie in few
    files or row groups: those are shuffled once, whole texts included. A table of
    enough partitions, as every large one is, stays as it is, without a shuffle.
    The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
