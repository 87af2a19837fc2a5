"""Chunk store: fixed schema, replace-by-filename, ingest summary (#5, #6, #57).

The store is a versioned table (``operators.versions``) in filename buckets that
split as they grow: a re-ingest rewrites only the buckets of the files it
touches, and delete and insert become visible with one switch of versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.versions import BUCKET_ROWS, FOLD_AFTER, VersionedTable

# --- fixed values: the chunk store schema ------------------------------------
STORE_SCHEMA = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("source_filename", T.StringType()),
    T.StructField("source_room_id", T.StringType()),
    T.StructField("source_sender", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("ingested_at", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("section_title", T.StringType()),
])
# -----------------------------------------------------------------------------


def conform(chunks: DataFrame) -> DataFrame:
    """#6: project and cast onto the store schema (missing columns -> null)."""
    cols = []
    for f in STORE_SCHEMA.fields:
        c = F.col(f.name) if f.name in chunks.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return chunks.select(*cols).to(STORE_SCHEMA)


def replace_by_filename(old: DataFrame, new: DataFrame, key: str = "source_filename") -> DataFrame:
    """#5: every file present in ``new`` loses all its old chunks (OVERWRITE)."""
    touched = new.select(key).distinct()
    kept = old.join(touched, key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def chunk_table(spark, path: str, bucket_rows: int = BUCKET_ROWS, fold_after: int = FOLD_AFTER) -> VersionedTable:
    """The stored chunks: a versioned table in which a file's chunks are replaced as a whole."""
    return VersionedTable(spark, path, STORE_SCHEMA, "source_filename", bucket_rows=bucket_rows, fold_after=fold_after)


def ingest_summary(files: DataFrame, new: DataFrame, old: DataFrame, ingested_at: str,
                   key: str = "source_filename") -> DataFrame:
    """#57: per file chars, sections, chunks stored, stale chunks deleted."""
    n = new.groupBy(key).agg(F.count(F.lit(1)).alias("chunks_stored"),
                             F.countDistinct(F.coalesce(F.col("section_index"), F.lit(-1))).alias("sections"))
    o = old.groupBy(key).agg(F.count(F.lit(1)).alias("stale_deleted"))
    return (files.join(n, key).join(o, key, "left")
            .select(key, F.col("n_chars").cast("long").alias("n_chars"), F.col("sections").cast("long").alias("sections"),
                    F.col("chunks_stored").cast("long").alias("chunks_stored"),
                    F.coalesce("stale_deleted", F.lit(0)).cast("long").alias("stale_deleted"),
                    F.lit(ingested_at).alias("ingested_at")))


def replace_files(spark, path: str, new_chunks: DataFrame, bucket_rows: int = BUCKET_ROWS) -> None:
    """#5 on disk: re-ingested files replace all their old chunks; every other
    file keeps its chunks untouched.

    Only the filename buckets the batch touches are read and written; a bucket
    that outgrows ``bucket_rows`` is split (``operators.versions``).
    """
    table = chunk_table(spark, path, bucket_rows)
    table.fold(table.write(conform(new_chunks)))
