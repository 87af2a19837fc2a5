"""A large collection: few blocks a term, and pairs scored from the texts of their chunks."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import index as IX
from corpuskit.operators import retrieval as R

KEYS = ["doc_id", "chunk_index"]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """600 chunks in ranges of 100 (they held ``RANGE`` chunks, however large the collection)."""
    patch = pytest.MonkeyPatch()
    patch.setattr(IX, "RANGE", 2)
    patch.setattr(IX, "LEAST_RANGES", 6, raising=False)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(d, c, f"f{d}.txt", " ".join(["often"] * (1 + d % 2) + rng.choices(words, k=rng.choice([1, 9, 30]))))
            for d in range(300) for c in range(2)]
    rows[7] = (*rows[7][:3], "")
    rows[8] = (*rows[8][:3], None)
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, source_filename string, content string")
    index = IX.write_index(chunks, str(tmp_path_factory.mktemp("wide")), KEYS)
    patch.undo()
    return index


def test_blocks_of_a_term_grow_with_the_ranges_only(wide):
    assert wide.blocks.filter("term = 'often'").count() <= 6
    assert wide.blocks.filter("term = 'often'").agg(F.sum("n"), F.sum("n_tokens")).first()[:] == (598, 598 + 299)
    want = R.postings(wide.chunks, KEYS).filter("term IS NOT NULL").select("term", *KEYS, "dl", F.col("tf").cast("int"))
    got = wide.postings.filter("term IS NOT NULL").select(want.columns)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert wide.stats.first()["n_docs"] == 600 == wide.blocks.agg(F.sum("n_first")).first()[0]


def test_pairs_are_scored_without_reading_blocks(spark, wide, capsys):
    q = spark.createDataFrame([(1, "often w3 w5"), (2, "w7"), (3, "unknown")], "query_id long, query string")
    pairs = spark.createDataFrame([(i, d, c) for i in (1, 2, 3) for d in range(60) for c in (0, 1)],
                                  "query_id long, doc_id long, chunk_index int")
    got = R.IndexScores(wide, q, KEYS).of(pairs)
    got.explain("formatted")
    assert "/blocks]" not in capsys.readouterr().out
    cols = ["query_id", *KEYS, F.round("bm25", 6).alias("bm25")]
    want = R.bm25_search(wide, q, KEYS).filter("doc_id < 60").select(cols)
    assert sorted(got.select(cols).collect()) == sorted(want.collect()) != []


@pytest.mark.parametrize("k", [1, 7, 700])
def test_wide_ranges_rank_the_same(spark, wide, k):
    q = spark.createDataFrame([(1, "often w3 w5 w8 w9 w10 w11 w12"), (2, "w7 w9"), (3, "often")], "query_id long, query string")
    cols = ["query_id", *KEYS, F.round("bm25", 5), "rank"]
    want = R.top_k(R.bm25_search(wide, q, KEYS), "query_id", "bm25", KEYS, k).select(cols).collect()
    assert sorted(R.bm25_topk(wide, q, KEYS, k).select(cols).collect()) == sorted(want)
