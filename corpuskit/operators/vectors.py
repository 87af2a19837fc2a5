"""Embeddings and approximate neighbours (#33, #38).

* ``embed_hashed``: default offline embedder, all JVM-side: token counts
  hashed into ``dim`` buckets (Spark ML ``HashingTF``), L2-normalised.
* ``embed_with``: pluggable model call through ``mapInPandas`` in Arrow
  batches of ``batch`` rows (order kept by an explicit key column).
* ``vector_topk_approx``: ``BucketedRandomProjectionLSH`` similarity join
  on unit vectors (Euclidean threshold from a cosine floor), then top-k.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import tokens

# --- fixed values ------------------------------------------------------------
EMBED_DIM = 64
EMBED_BATCH = 128
# -----------------------------------------------------------------------------


def embed_hashed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = EMBED_DIM) -> DataFrame:
    """#33 default: hashed term counts -> unit vector (array<double>)."""
    t = df.withColumn("_tok", tokens(text_col))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(t)
    nv = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0).transform(tf)
    return nv.withColumn(out_col, vector_to_array("_nv")).drop("_tok", "_tf", "_nv")


def embed_with(df: DataFrame, key: str, text_col: str, fn: Callable[[list[str]], list[list[float]]],
               out_schema: str, batch: int = EMBED_BATCH) -> DataFrame:
    """#33 pluggable: ``fn(texts) -> vectors`` per call of at most ``batch`` rows.

    A failed call fails the task (and Spark retries it); rows keep their key.
    """
    def run(it):
        for pdf in it:
            for at in range(0, len(pdf), batch):  # calls of bounded size, whatever the Arrow batch
                part = pdf.iloc[at:at + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": fn(part[text_col].tolist())})
    return df.select(key, text_col).mapInPandas(run, out_schema)


def _unit(df: DataFrame, vec: str) -> DataFrame:
    v = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return Normalizer(inputCol="_v", outputCol="_u", p=2.0).transform(v).drop("_v")


def vector_topk_approx(items: DataFrame, queries: DataFrame, key: str, vec: str, qid: str, qvec: str,
                       k: int = 5, min_cosine: float | None = None, bucket_length: float = 1.0,
                       tables: int = 4, seed: int = 7) -> DataFrame:
    """#38: approximate top-k by cosine via an LSH similarity join.

    Pairs are only compared inside shared hash buckets; on unit vectors the
    Euclidean distance d and cosine c satisfy d^2 = 2 - 2c, so a cosine
    floor becomes a distance threshold.
    """
    it = _unit(items.select(key, vec), vec)
    qs = _unit(queries.select(F.col(qid).alias("_q"), F.col(qvec).alias("_qv")), "_qv")
    lsh = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", bucketLength=bucket_length,
                                      numHashTables=tables, seed=seed)
    model = lsh.fit(it)
    # without a floor every pair of a shared bucket counts (unit vectors: distance at most 2)
    thr = math.sqrt(max(0.0, 2.0 - 2.0 * (-1.0 if min_cosine is None else min_cosine))) + 1e-9
    j = model.approxSimilarityJoin(qs, it, thr, distCol="_d")
    pairs = j.select(F.col("datasetA._q").alias(qid), F.col(f"datasetB.{key}").alias(key),
                     (1.0 - F.col("_d") * F.col("_d") / 2.0).alias("score"))
    w = Window.partitionBy(qid).orderBy(F.round("score", 6).desc(), F.col(key))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
