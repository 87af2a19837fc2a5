"""#100 stream_ingest (+#5 incremental): continuous ingest with replace by
filename.

Each micro-batch of documents is cleaned and chunked (#8, #25-28); within a
batch the latest version of a file wins. A batch is one write to the versioned
chunk store: delete and insert of a file become visible at once (the reference
deletes first and can lose a file if the insert fails), a replayed epoch
changes nothing, and open deltas are folded into the filename buckets that they
touch. A document without text is refused, so its stored chunks stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators.prepare import prepare_chunks
from corpuskit.operators.store import chunk_table, conform
from corpuskit.operators.versions import FOLD_AFTER, VersionedTable


def ingest_batch_fn(path: str, ingested_at: str, fold_after: int = FOLD_AFTER):
    def fn(batch: DataFrame, epoch_id: int) -> None:
        cols = [c for c in batch.columns if c != "doc_id"]
        docs = batch.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "seq").alias("_b")).select("doc_id", "_b.*")
        chunks = conform(prepare_chunks(docs, ingested_at))
        table = chunk_table(batch.sparkSession, path, fold_after=fold_after)
        table.write(chunks, epoch=epoch_id)
    return fn


def stored_chunks(spark: SparkSession, path: str) -> VersionedTable:
    return chunk_table(spark, path)
