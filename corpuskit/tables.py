"""Loading the driver's parquet tables.

Timestamps arrive as TIMESTAMP_NTZ; they are cast once, here, to TIMESTAMP
(the session runs in UTC so wall-clock values do not move).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows carry real per-row work (long texts, fact rows).
SPREAD = {"documents", "pages", "conversations", "lineitem", "orders", "events"}


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """Read one table; NTZ timestamps become TIMESTAMP.

    ``spread``: when the scan yields fewer splits than the cluster's default
    parallelism (a file written as a single row group), rows are dealt
    round-robin to that many partitions so row-local work (chunking,
    tokenising, HTML stripping) is not serialised on one core. Inputs that
    already arrive in many splits - the normal case at scale - are left as
    they are, so no shuffle is added there.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    casts = [
        F.col(f.name).cast("timestamp").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df = df.select(*casts)
    if spread if spread is not None else name in SPREAD:
        try:  # classic sessions only (Spark Connect has no RDD / SparkContext)
            target = spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < target:
                df = df.repartition(target)
        except AttributeError:
            pass
    return df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)
