"""Approximate neighbours vs exact, near-duplicates vs brute-force Jaccard."""

from pyspark.sql import functions as F

from corpuskit.operators import vectors as V
from corpuskit.operators.retrieval import vector_topk


def test_approx_recall(spark, tables_small):
    e = tables_small.embeddings
    q = e.filter(F.col("vec_id") < 20).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    exact = {(r.qid, r.vec_id) for r in vector_topk(e, q, "vec_id", "embedding", "qid", "qv", k=5).collect()}
    approx = {(r.qid, r.vec_id) for r in V.vector_topk_approx(e, q, "vec_id", "embedding", "qid", "qv", k=5,
                                                              min_cosine=-1.0, tables=8).collect()}
    assert len(exact & approx) / len(exact) >= 0.8


def test_embed_unit_norm(spark):
    df = spark.createDataFrame([(1, "apple banana apple"), (2, "cherry")], "id long, text string")
    rows = V.embed_hashed(df, "text").collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 and len(r.embedding) == 64 for r in rows)


def test_embed_with_batches_and_keys(spark):
    sizes = []

    def fake_model(texts):
        sizes.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(300)], "id long, text string").repartition(1)
    out = V.embed_with(df, "id", "text", fake_model, "id long, embedding array<double>", batch=128).collect()
    assert sorted((r.id, r.embedding[0]) for r in out) == [(i, float(i % 7)) for i in range(300)]
