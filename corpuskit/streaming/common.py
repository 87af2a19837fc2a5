"""Helpers shared by the streaming operators: scratch folders under the
shared checkpoint directory, file drops derived from tables, and running a
query to completion with an ``availableNow`` trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuskit.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def run_drops(drops: list[DataFrame], folder: str, query_builder, checkpoint: str) -> None:
    """Feed drops to a file stream one after another.

    Each drop (``folder/drop=<i>``) is written by all its tasks, in as many
    files as it has partitions, and then read as one micro-batch: the query is
    restarted from its checkpoint for each drop.
    """
    for i, d in enumerate(drops):
        d.write.mode("overwrite").parquet(f"{folder}/drop={i:04d}")
        run_available_now(query_builder, checkpoint)


def run_available_now(query_builder, checkpoint: str) -> None:
    """Start a streaming write with an ``availableNow`` trigger and wait.

    ``query_builder(writer_options)`` returns a ``DataStreamWriter``; the
    checkpoint location makes the query restartable after executor or driver
    loss (offsets + state are recovered from it).
    """
    q = query_builder().option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
