"""Session helpers.

The library itself never creates a session: operators take DataFrames. These
helpers are for tests, ``bench.py`` and local runs. On a cluster the session
is supplied by the platform and ``spark.checkpoint.dir`` names a shared folder.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every corpuskit session wants, whatever the cluster size.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of unreachable DataFrames are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpuskit",
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (never used by operators)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("CORPUSKIT_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used for tables that several branches of one plan read (the inverted
    index, the chunk store), so they are computed once and survive executor
    loss without recomputing the whole lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is executed meanwhile deletes its shuffle files when it ends, not when the driver collects its garbage.

    For steps that write a table and read that table from then on: a plan that is executed
    again later would have to make its shuffles anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Only when it is
    unset - local tests - a fresh scratch folder is created and registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpuskit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - Spark Connect: the server's checkpoint dir applies
        pass
    return path
