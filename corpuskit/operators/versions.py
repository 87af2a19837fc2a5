"""A versioned table of keyed rows: snapshot buckets, open deltas, a manifest (#4, #5, #99, #100).

* A write adds a delta: a folder of its own, then a manifest that names it. A
  manifest is one small file written once under the next number; it is the
  switch, so a crash before it leaves the table as it was, a reader always sees
  one whole version, and of two writers at once the later one gets an error.
* ``fold`` merges the open deltas into the snapshot. The snapshot is laid out by
  extendible hashing: a bucket is the rows whose key hashes end in its bits, and
  a bucket that outgrows ``bucket_rows`` is split by one more bit (unless all its
  rows have one key). Only the buckets that the deltas touch are read and
  written anew; the others stay where they are, in every later version.
* ``read`` is the snapshot and the open deltas: rows of keys that no delta
  touches pass through unchanged, without a shuffle if the deltas' keys are few.

The rows of a key are replaced as a whole, by the write that wins: the one with
the highest ``rank`` column (if the table has one), the latest of equals. A
write can also remove keys. ``epoch`` makes a stream's writes idempotent: an
epoch at or below the last one written is not written again. ``position`` is a
number that a writer keeps with the version, switched with it. Rows without a
key are not stored.

Folders that no manifest names any more are left for a cleaner; the manifest
holds a row per bucket and per open delta (at most ``fold_after`` of these).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from corpuskit.operators.retrieval import small
from corpuskit.session import materialize

BUCKET_ROWS = 200_000
FOLD_AFTER = 8
MOST_DEPTH = 48


class ConflictError(RuntimeError):
    """Another writer has written the version that was to be written."""


@dataclass(frozen=True)
class Manifest:
    """``buckets``: (depth, bits, folder, rows); ``deltas``: (number, folder), oldest first."""

    version: int = 0
    buckets: list = field(default_factory=list)
    deltas: list = field(default_factory=list)
    epoch: int = -1
    position: int = 0


class VersionedTable:
    """Rows of ``schema`` under ``path``, replaced by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, rank: str | None = None,
                 bucket_rows: int = BUCKET_ROWS, fold_after: int = FOLD_AFTER):
        self.spark, self.path, self.key, self.rank = spark, path.rstrip("/"), key, rank
        self.schema = spark.createDataFrame([], schema).schema
        self.bucket_rows, self.fold_after = bucket_rows, fold_after
        self._stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())])

    # ------------------------------------------------------------- manifests

    def manifest(self) -> Manifest:
        """The live version; one without rows if none was written yet."""
        try:
            names = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
                "pathGlobFilter", "part-*").load(f"{self.path}/manifest").select("path")
            # numbers are padded, so texts sort as versions do; of one version the first file counts
            number = F.regexp_extract("path", "/manifest/([0-9]+)/[^/]*$", 1)
            last = names.groupBy(number.alias("v")).agg(F.min("path").alias("path")).agg(F.max_by("path", "v")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # a table that cannot be read is not an empty one
                raise
            last = None
        if last is None:
            return Manifest()
        return Manifest(**json.loads(self.spark.read.option("wholetext", True).text(last).first()[0]))

    def _switch(self, new: Manifest) -> Manifest:
        new = Manifest(**json.loads(json.dumps(asdict(new))))
        folder = f"{self.path}/manifest/{new.version:012d}"
        one = self.spark.createDataFrame([(json.dumps(asdict(new)),)], "value string").coalesce(1)
        try:
            one.write.mode("errorifexists").text(folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            if self.manifest().version < new.version:  # what a writer left that was lost amid its switch
                one.write.mode("append").text(folder)
        if self.manifest() != new:
            raise ConflictError(f"version {new.version} was written by another writer")
        return new

    # --------------------------------------------------------------- reading

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self._stored)

    def _buckets(self, buckets: list) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/depth={depth}/bits={bits}" for depth, bits, folder, _ in buckets]
        return self.spark.read.schema(self._stored).parquet(*paths) if paths else self._empty()

    def _deltas(self, m: Manifest) -> DataFrame:
        out = self._empty().withColumn("_seq", F.lit(0).cast("long"))
        for number, folder in m.deltas:
            rows = self.spark.read.schema(self._stored).parquet(f"{self.path}/data/{folder}")
            out = out.unionByName(rows.withColumn("_seq", F.lit(number).cast("long")))
        return out

    def _merged(self, snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
        """The winning rows of the keys that the deltas touch, removed ones included."""
        order = F.struct(F.col(self.rank) if self.rank else F.lit(0), F.col("_seq"))
        every = snapshot.withColumn("_seq", F.lit(0).cast("long")).unionByName(deltas).withColumn("_order", order)
        won = every.groupBy(self.key).agg(F.max("_order").alias("_order"))
        return every.join(won, [self.key, "_order"], "left_semi").select(*self._stored.fieldNames())

    def read(self, version: Manifest | None = None) -> DataFrame:
        """The rows of the live version (or of one read before)."""
        m = version or self.manifest()
        snapshot = self._buckets(m.buckets)
        if not m.deltas:
            return snapshot.select(*self.schema.fieldNames())
        deltas = self._deltas(m)
        touched = small(materialize(deltas.select(self.key).distinct()))
        merged = self._merged(snapshot.join(touched, self.key, "left_semi"), deltas)
        rest = snapshot.join(touched, self.key, "left_anti")
        return rest.unionByName(merged.filter(~F.col("_gone"))).select(*self.schema.fieldNames())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only their buckets and the open deltas are read."""
        m = self.manifest()
        wanted = small(materialize(keys.select(self.key).distinct()))
        only = replace(m, buckets=self._touched(m, wanted))
        return self.read(only).join(wanted, self.key, "left_semi")

    # --------------------------------------------------------------- writing

    def write(self, rows: DataFrame, removed: DataFrame | None = None, epoch: int | None = None,
              position: int | None = None) -> Manifest:
        """Replace the keys of ``rows`` (all rows of a key come in one write) and remove those of ``removed``."""
        m = self.manifest()
        if epoch is not None and epoch <= m.epoch:  # this epoch was switched live before a restart
            return m
        new = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(False).alias("_gone")).filter(
            F.col(self.key).isNotNull())
        if removed is not None:
            gone = removed.select(self.key).distinct().join(new.select(self.key).distinct(), self.key, "left_anti")
            new = new.unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        folder = f"delta-{uuid.uuid4().hex}"
        new.to(self._stored).write.parquet(f"{self.path}/data/{folder}")
        m = self._switch(replace(m, version=m.version + 1, deltas=[*m.deltas, (m.version + 1, folder)],
                                 epoch=m.epoch if epoch is None else epoch,
                                 position=m.position if position is None else position))
        return self.fold(m) if len(m.deltas) >= self.fold_after else m

    # --------------------------------------------------------------- folding

    def _located(self, df: DataFrame, buckets: list) -> DataFrame:
        """``df`` with ``depth`` and ``bits`` of the bucket of its key's hash ``_h``."""
        table = self.spark.createDataFrame([(d, b) for d, b, *_ in buckets], "depth int, bits long")
        depths = sorted({d for d, *_ in buckets})
        at = df.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn(
            "bits", F.col("_h").bitwiseAND(F.expr("shiftleft(1L, depth) - 1")))
        return at.join(small(table), ["depth", "bits"])

    def _touched(self, m: Manifest, keys: DataFrame) -> list:
        """The buckets of some keys: at most as many as there are."""
        if not m.buckets:
            return []
        found = self._located(keys.select(F.xxhash64(self.key).alias("_h")), m.buckets)
        live = {(d, b): (d, b, *rest) for d, b, *rest in m.buckets}
        return [live[r["depth"], r["bits"]] for r in found.select("depth", "bits").distinct().collect()]

    def fold(self, version: Manifest | None = None) -> Manifest:
        """Merge the open deltas into the buckets that they touch; split those that outgrow their size."""
        m = version or self.manifest()
        if not m.deltas:
            return m
        deltas = self._deltas(m)
        old = self._touched(m, deltas.select(self.key).distinct())
        folder = f"fold-{uuid.uuid4().hex}"
        merged = self._merged(self._buckets(old), deltas).filter(~F.col("_gone")).withColumn("_h", F.xxhash64(self.key))
        merged.write.parquet(f"{self.path}/data/{folder}/merged")
        merged = self.spark.read.schema(merged.schema).parquet(f"{self.path}/data/{folder}/merged")

        # the buckets of the result: the old ones (one for the first fold), split while they are too large
        open_buckets, done = [(d, b) for d, b, *_ in old] or ([] if m.buckets else [(0, 0)]), []
        while open_buckets:
            sizes = self._located(merged.select("_h"), open_buckets).groupBy("depth", "bits").agg(
                F.count(F.lit(1)).alias("n"), (F.min("_h") < F.max("_h")).alias("many")).collect()
            split = [r for r in sizes if r["n"] > self.bucket_rows and r["many"] and r["depth"] < MOST_DEPTH]
            done += [(r["depth"], r["bits"], folder, r["n"]) for r in sizes if r not in split]
            open_buckets = [(r["depth"] + 1, r["bits"] + (side << r["depth"])) for r in split for side in (0, 1)]
        if done:
            located = self._located(merged, done)
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            located.repartition(parts, "depth", "bits").select(*self._stored.fieldNames(), "depth", "bits").write.mode(
                "append").partitionBy("depth", "bits").parquet(f"{self.path}/data/{folder}")
        kept = [x for x in m.buckets if tuple(x[:2]) not in {tuple(o[:2]) for o in old}]
        return self._switch(replace(m, version=m.version + 1, buckets=[*kept, *done], deltas=[]))
