"""The whole pipeline over awkward documents and over none."""

import corpus_pipeline
from pyspark.sql import functions as F


def run(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_over_awkward_documents(spark, awkward, tmp_path):
    prose = " ".join(f"The river{i} ran past stone{i} and field{i} while people{i} talked." for i in range(12))
    clean = spark.createDataFrame([(100, prose), (100, prose), (101, "password=hunter2hunter2 " + prose[::-1][:300] + "."),
                                   (102, None)], "doc_id long, text string")
    docs = awkward.unionByName(clean.withColumn("source", F.lit("c")), allowMissingColumns=True).withColumn("lang", F.lit(None).cast("string"))
    out = run(spark, docs, tmp_path)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    assert 100 in {r["doc_id"] for r in rows} and not {2, 3, 4, 102} & {r["doc_id"] for r in rows}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, at, n), (t, to, _) in zip(places, places[1:]):
        assert (to == at + n) if s == t else to == 0


def test_pipeline_over_an_empty_table(spark, nothing, tmp_path):
    assert run(spark, nothing.withColumn("lang", F.lit(None).cast("string")), tmp_path).count() == 0
