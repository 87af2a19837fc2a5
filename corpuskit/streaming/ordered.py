"""Ordered folds of a stream, row by row, with the state in a versioned table (#98, #101).

A micro-batch and the stored state of its keys are sorted together by (key,
order) inside their partitions; a task then walks over its rows and holds one
key's state and one Arrow batch, however many rows a key has (Spark's sort
spills). Nothing else is needed of a key's rows at once, so a key with a third of
the stream is slow, never large.

A micro-batch is written in two steps: its results to the folder of its epoch
(written over if the epoch is replayed), then the new state as one switch of the
versioned table, with the epoch. An epoch at or below the table's is done: it is
not folded again. State that a fold gives up (null) is removed.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.retrieval import small
from corpuskit.operators.versions import FOLD_AFTER, VersionedTable
from corpuskit.session import materialize

Step = Callable[[object, dict], tuple[object, dict]]


def state_table(spark: SparkSession, path: str, key: str, state: str, fold_after: int = FOLD_AFTER) -> VersionedTable:
    """(key, state): the state of every key that has one."""
    return VersionedTable(spark, path, f"{key} long, state {state}", key, fold_after=fold_after)


def fold(batch: DataFrame, state: DataFrame, key: str, order: list[str], step: Step, made: str, kind: str) -> DataFrame:
    """Rows of ``batch`` with the columns of ``made``, and (``_last`` true) the state after each key.

    ``step(state, row)`` returns the state after a row and what the row makes;
    the state is None at a key's first row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T._parse_datatype_string(made)
    state_type = T._parse_datatype_string(kind)
    own = [T.StructField(f.name, f.dataType) for f in batch.schema.fields]  # null in the rows of a state
    schema = T.StructType([*own, *added.fields, T.StructField("state", state_type), T.StructField("_last", T.BooleanType())])
    out, names = to_arrow_schema(schema), batch.columns
    keys = small(materialize(batch.select(key).distinct()))
    held = state.join(keys, key, "left_semi").select(key, "state", F.lit(0).alias("_kind"))
    both = batch.withColumn("_kind", F.lit(1)).unionByName(held, allowMissingColumns=True).select(*names, "state", "_kind")
    parts = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = both.repartition(parts, key).sortWithinPartitions(key, "_kind", *order)

    def run(batches):
        current, value = None, None
        for b in batches:
            done = []
            for row in b.to_pylist():
                if row[key] != current:
                    if current is not None:
                        done.append({key: current, "state": value, "_last": True})
                    current, value = row[key], None
                if row.pop("_kind") == 0:
                    value = row["state"]
                    continue
                value, found = step(value, row)
                done.append({**row, **found, "state": None, "_last": False})
            yield pa.RecordBatch.from_pylist(done, out)
        if current is not None:
            yield pa.RecordBatch.from_pylist([{key: current, "state": value, "_last": True}], out)

    return rows.mapInArrow(run, schema)


def batch_fn(out: str, state_path: str, key: str, order: list[str], step: Step, made: str, kind: str,
             prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
             idle: Callable[[DataFrame, DataFrame], DataFrame] | None = None, idle_every: int = 8):
    """Function for ``foreachBatch``: results to ``out/epoch=<n>``, state to ``state_path``.

    ``idle(state, batch)`` names the keys (of a state table) that may be given
    up; it is asked every ``idle_every`` epochs.
    """
    def fn(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        table = state_table(spark, state_path, key, kind)
        if epoch_id <= table.manifest().epoch:
            return
        rows, before = prepare(batch), table.read()
        found = materialize(fold(rows, before, key, order, step, made, kind))
        results = found.filter("NOT _last").drop("state", "_last")
        results.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
        after = found.filter("_last").select(key, "state")
        gone = after.filter("state IS NULL").select(key)
        if idle is not None and epoch_id % idle_every == idle_every - 1:
            gone = gone.unionByName(idle(before, rows))
        table.write(after.filter("state IS NOT NULL"), removed=gone, epoch=epoch_id)
    return fn


def results(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All results so far (``schema``: that of the prepared rows and what they make)."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(out).drop("epoch")
