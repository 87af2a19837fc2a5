"""#99 stream_sync: incremental item sync by version, as a file stream.

Position 0 = initial full load of top-level items only; afterwards a batch
contributes the items with version > position; position then becomes the
library version (the highest version seen). The items are a versioned table
(``operators.versions``), highest version winning; a micro-batch is one write,
and the position and the batch's epoch are switched live with it, so a replayed
epoch changes nothing. Open deltas are folded into the snapshot as they add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators.items import top_level
from corpuskit.operators.versions import FOLD_AFTER, VersionedTable


def item_table(spark: SparkSession, path: str, schema, fold_after: int = FOLD_AFTER) -> VersionedTable:
    return VersionedTable(spark, path, schema, "item_key", rank="version", fold_after=fold_after)


def sync_batch_fn(path: str, fold_after: int = FOLD_AFTER):
    def fn(batch: DataFrame, epoch_id: int) -> None:
        table = item_table(batch.sparkSession, path, batch.schema, fold_after)
        at = table.manifest().position
        chosen = top_level(batch) if at == 0 else batch.filter(F.col("version") > at)
        # of several versions of an item in one batch the highest counts
        cols = [c for c in batch.columns if c != "item_key"]
        one = chosen.groupBy("item_key").agg(F.max_by(F.struct(*cols), "version").alias("_b")).select("item_key", "_b.*")
        seen = batch.agg(F.max("version")).first()[0]
        table.write(one.select(*batch.columns), epoch=epoch_id, position=at if seen is None else max(at, seen))
    return fn
