"""Packs of rows, vectors of listed counts, and shuffle files that end with their step."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import embed as E
from corpuskit.operators import packed as P
from corpuskit.session import shuffles_dropped


def test_packs_hold_every_row_in_its_order():
    rng = np.random.default_rng(1)
    to, size = rng.integers(0, 5, 40), rng.integers(0, 4, 40)
    flat = np.arange(size.sum())
    terms = pa.array([None if i % 7 == 0 else f"t{i}" for i in range(40)])
    out = P.pack(to, {"term": terms}, {"n": (size, {"v": pa.array(flat), "w": pa.array([None if x % 3 else str(x) for x in flat])})})
    assert out["to"].to_pylist() == sorted(set(to.tolist())) and not len(P.pack(to[:0], {"term": terms[:0]}, {"n": (size[:0], {})}))
    for number, x in zip(out["to"].to_pylist(), P.unpack(out["data"], 1)):
        at = np.flatnonzero(to == number)
        assert x["term"].to_pylist() == [terms[i].as_py() for i in at] and x["n"].to_pylist() == size[at].tolist()
        want = np.concatenate([flat[size[:i].sum():size[:i + 1].sum()] for i in at])
        assert x["v"].to_pylist() == want.tolist() and x["w"].to_pylist() == [None if v % 3 else str(v) for v in want]
        assert [len(v) for v in P.as_lists(x["n"], x["v"]).to_pylist()] == size[at].tolist()
    assert sum(len(x["term"]) for x in P.unpack(out["data"])) == 40


def test_listed_counts_make_the_vectors_of_single_ones(spark):
    rng = np.random.default_rng(2)
    single = [(f"k{d}" if d % 5 else None, int(c), f"w{w}", int(rng.integers(1, 5)))
              for d in range(30) for c in range(2) for w in rng.choice(60, 12, replace=False)]
    counts = spark.createDataFrame([*single, ("k1", 0, None, 3), ("gone", 0, "w1", 3), *single[12:30]], "a string, b int, term string, tf int")
    listed = counts.groupBy("term").agg(*[F.collect_list(F.coalesce(c, F.lit("-")) if c == "a" else c).alias(c) for c in ("a", "b", "tf")])
    listed = listed.withColumn("a", F.transform("a", lambda x: F.when(x != "-", x)))
    rows = spark.createDataFrame([(f"k{d}" if d % 5 else None, c) for d in range(32) for c in range(2)] + [("k1", 0)], "a string, b int")
    fitted = E.fit(spark.createDataFrame([(f"w{i}", i + 1) for i in range(50)], "term string, df long"), F.lit(100), dim=8)
    summed = {}
    weights = {r["term"]: (r["place"], r["weight"]) for r in fitted.collect()}
    for a, b, term, tf in (tuple(r) for r in counts.collect()):
        if term in weights:
            v = summed.setdefault((a, b), np.zeros(8))
            v[weights[term][0]] += tf * weights[term][1]
    for given in (counts, listed):
        got = E.embed_terms(rows, given, fitted, ["a", "b"], 8).collect()
        assert len(got) == rows.count()
        for r in got:
            want = summed.get((r["a"], r["b"]), np.zeros(8)) if r["a"] is not None else np.zeros(8)
            assert r["embedding"] == pytest.approx(want / (np.linalg.norm(want) or 1), abs=1e-12)


def test_no_row_of_a_single_count_is_shuffled(spark, capsys):
    counts = spark.createDataFrame([(1, "a", 2)], "id long, term string, tf long")
    fitted = E.fit(spark.createDataFrame([("a", 1)], "term string, df long"), F.lit(1))
    E.embed_terms(counts.select("id"), counts, fitted, ["id"]).explain("simple")
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning(to#" in plan and "Exchange hashpartitioning(term#" not in plan


def test_shuffle_files_end_with_the_step(spark, tmp_path):
    own = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for top in own for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}

    before = files()
    with shuffles_dropped(spark):
        spark.range(5000).repartition(7, "id").write.parquet(str(tmp_path / "x"))
        assert spark.read.parquet(str(tmp_path / "x")).count() == 5000
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
