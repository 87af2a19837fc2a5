"""Stored vector cells: recall, visits, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import cells as C
from corpuskit.operators.retrieval import vector_topk
from corpuskit.tables import Tables


def exact(spark, items, queries, k):
    rows = vector_topk(items, queries, "vec_id", "v", "qid", "qv", k=k).collect()
    return {(r["qid"], r["vec_id"]) for r in rows}


def clustered(spark, n=12_000, d=32, groups=120, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, d))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    near = x[rng.integers(0, n, 60)] + 0.05 * rng.normal(size=(60, d))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "qid long, qv array<double>")
    return items, queries


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    from corpuskit.plans import vectors as P
    from corpuskit.plans.search import query_vectors
    t = Tables(spark, sf)
    got = P.q_vector_topk_approx(t).collect()
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in vector_topk(
        t.embeddings, query_vectors(t), "vec_id", "embedding", "query_id", "qv", k=5).collect()}
    hit = [r for r in got if (r["query_id"], r["vec_id"]) in want]
    assert len(hit) >= 0.95 * len(want)
    assert all(abs(want[r["query_id"], r["vec_id"]] - r["score"]) < 1e-4 for r in hit)


def test_clustered_vectors_are_found_in_a_few_percent_of_the_rows(spark, tmp_path):
    items, queries = clustered(spark)
    index = C.write_cells(items, "vec_id", "v", str(tmp_path / "cells"), cells=150)
    want = exact(spark, items, queries, 5)
    got = {(r["qid"], r["vec_id"]) for r in C.search(index, queries, "qid", "qv", "vec_id", 5).collect()}
    assert len(got & want) >= 0.95 * len(want)
    asked = queries.select("qid", F.col("qv").alias("v"))
    _, visits, _ = C.phases(index, asked, 5, 50, 4, 3.0)
    sizes = {(r["cell"], r["part"]): r["count"] for r in index.lists.groupBy("cell", "part").count().collect()}
    compared = sum(sizes[r["cell"], r["part"]] for r in visits.collect())
    assert compared < 0.1 * 60 * 12_000
    # the written index is read back as it was
    again = C.open_cells(spark, str(tmp_path / "cells"))
    assert np.array_equal(again.centres, index.centres) and index.lists.count() == 12_000 == index.vectors.count()


def test_a_search_reads_its_cells_only(spark, tmp_path, capsys):
    items, queries = clustered(spark, n=2000)
    index = C.write_cells(items, "vec_id", "v", str(tmp_path / "cells"), cells=40)
    C.search(index, queries.limit(1), "qid", "qv", "vec_id", 5).explain("formatted")
    plan = capsys.readouterr().out
    assert "/vectors]" in plan and "cell" in plan.split("PartitionFilters: [", 1)[1].split("\n")[0]


def test_a_vector_of_a_third_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    x[::3] = x[0]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
    queries = spark.createDataFrame([(1, x[0].tolist()), (2, x[1].tolist())], "qid long, qv array<float>")
    index = C.write_cells(items, "vec_id", "v", str(tmp_path / "cells"), block=50)
    assert index.parts.max() >= 6
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in C.search(index, queries, "qid", "qv", "vec_id", 4).collect()}
    assert [got[1, i] for i in (1, 2, 3, 4)] == [0, 3, 6, 9] and got[2, 1] == 1


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [1.0]), (6, [0.0, 0.0]), (7, [1e200, 1e200]),
            (8, [1.0, None]), (None, [1.0, 0.0]), (9, [float("inf"), 0.0]), (10, [])]
    items = spark.createDataFrame(rows, "vec_id long, v array<double>")
    index = C.write_cells(items, "vec_id", "v", str(tmp_path / "cells"))
    queries = spark.createDataFrame([(1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0])], "qid long, qv array<double>")
    got = C.search(index, queries, "qid", "qv", "vec_id", 9).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == 1][:1] == [1]
    assert {r["vec_id"] for r in got if r["qid"] == 1} == {1, 2, 6, 7} == {r["vec_id"] for r in got if r["qid"] == 3}
    assert {r["qid"] for r in got} == {1, 3}
    assert C.write_cells(items.limit(0), "vec_id", "v", str(tmp_path / "none")) is None
