"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import checkpoint_dir, materialize

__all__ = ["WORD", "checkpoint_dir", "map_rows", "materialize", "n_words", "read", "stored"]

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), JVM side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (cuts lineage).

    Columnar, so wide intermediate results take less room than a checkpoint;
    any executor can read it again after another one is lost.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpuskit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """Row-local Python over Arrow batches, one output batch per input batch.

    ``make()`` runs once per task (it loads vocabularies there) and returns a
    function of the input columns that yields output tuples for one row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    # an output batch is cut at this many rows, so one long row stays bounded
    limit = 20_000

    def run(batches):
        row = make()
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for made in row(*values):
                    rows.append(made)
                    if len(rows) >= limit:
                        yield _batch(rows, out)
                        rows = []
            if rows:
                yield _batch(rows, out)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)
