"""The index by term: layout, partition filters, and top-k that skips ranges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import index as IX
from corpuskit.operators import retrieval as R

KEYS = ["doc_id", "chunk_index"]


@pytest.fixture(scope="module")
def words():
    return [f"w{i}" for i in range(4000)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, words):
    rng = random.Random(2)
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(d, c, f"f{d % 90}.txt", " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 60]))))
            for d in range(1500) for c in range(2)]
    # one term stands in a third of the chunks, ten times in a few
    docs = [(d, c, f, t + (" hot" * (10 if d % 90 == 0 else 1) if d % 3 == 0 else "")) for d, c, f, t in docs]
    docs += [(9000, 0, "e.txt", ""), (9001, 0, None, "alone"), (9002, 0, "e.txt", None)]
    chunks = spark.createDataFrame(docs, "doc_id long, chunk_index int, source_filename string, content string")
    return IX.write_index(chunks, str(tmp_path_factory.mktemp("index")), KEYS)


def test_blocks_hold_every_posting_once(spark, index):
    want = R.postings(index.chunks, KEYS).filter("term IS NOT NULL").select("term", *KEYS, "dl", F.col("tf").cast("int"))
    got = index.postings.filter("term IS NOT NULL").select(want.columns)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert index.stats.first().asDict() == {"n_docs": 3003, "avgdl": pytest.approx(
        index.chunks.select(F.avg(F.size(F.filter(F.split(F.coalesce("content", F.lit("")), " "), lambda w: w != "")))).first()[0])}
    sizes = index.blocks.groupBy("range").agg(F.max("n").alias("n")).select(F.max("n")).first()[0]
    assert sizes <= 8 * IX.RANGE  # a block is a part of a range, also for the term of a third of all chunks
    assert index.blocks.filter("term = 'hot'").count() > 5


def test_a_search_of_few_terms_reads_few_files(spark, index, capsys):
    q = spark.createDataFrame([(1, "w7 w1500")], "query_id long, query string")
    held = [IX.part_of(F.lit(w), index.parts).alias(w) for w in ("w7", "w1500")]
    numbers = sorted(set(spark.range(1).select(*held).first()))
    for search in (R.bm25_search(index, q, KEYS), R.bm25_topk(index, q, KEYS)):
        search.explain("formatted")
        plan = capsys.readouterr().out
        scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "/blocks]" in x]
        assert scans
        for scan in scans:  # the parts of these terms only, and the terms inside their files
            found = re.search(r"PartitionFilters: \[.*?part#\d+ (?:IN \(([0-9,]+)\)|= ([0-9]+))", scan)
            assert sorted(int(x) for x in (found[1] or found[2]).split(",")) == numbers, scan
            assert "In(term, [w1500,w7])" in scan or "In(term, [w7,w1500])" in scan


@pytest.mark.parametrize("k, first", [(1, 1), (5, 4), (5, 1), (40, 2), (404, 1)])
def test_skipping_ranges_changes_nothing(spark, index, words, k, first):
    rng = random.Random(k)
    texts = [" ".join(rng.sample(words[:2000], n)) for n in (1, 2, 5, 20)] + ["hot", "hot w0 w1", "alone", "unknown", "", "the"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    cols = ["query_id", *KEYS, F.round("bm25", 5), "rank"]
    want = R.top_k(R.bm25_search(index, q, KEYS), "query_id", "bm25", KEYS, k).select(cols).collect()
    got = R.bm25_topk(index, q, KEYS, k, first=first, short=k % 9).select(cols).collect()
    assert sorted(got) == sorted(want)


def test_most_ranges_of_a_rare_and_a_frequent_term_are_skipped(spark, index):
    q = spark.createDataFrame([(1, "hot"), (2, "w3900 w3901 w3902 w0")], "query_id long, query string")
    blocks, weighted, avgdl = R._weighted(index, R.query_terms(q))
    left = R._reaching(blocks, weighted, avgdl, KEYS, 3, "query_id", R.BM25_K1, R.BM25_B, 4)
    met = blocks.join(weighted, ["part", "term"]).select("query_id", "range").distinct()
    assert left.count() < met.count() / 2


def test_source_version_lists_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    one = IX.source_version(spark, path)
    assert one == IX.source_version(spark, path)
    spark.range(6).write.mode("append").parquet(path)
    assert one != IX.source_version(spark, path)


def test_files_grow_with_the_parts_only(spark, tmp_path, monkeypatch):
    """Four times the chunks: four times the parts and files (a part was cut into slices, whose number grew as well)."""
    monkeypatch.setattr(IX, "PART_CHUNKS", 40)
    monkeypatch.setattr(IX, "SLICE", 4, raising=False)
    rng = random.Random(4)
    for n in (500, 2000):
        rows = [(d, 0, f"f{d}.txt", " ".join(["every", *rng.choices([f"w{i}" for i in range(300)], k=8)])) for d in range(n)]
        chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, source_filename string, content string")
        index = IX.write_index(chunks, str(tmp_path / str(n)), KEYS)
        assert index.parts == -(-n // 40)
        for name in ("blocks", "terms"):
            assert len(list((tmp_path / str(n) / name).rglob("*.parquet"))) <= 1.5 * index.parts + 8, name
        assert index.terms.filter("term = 'every'").select("df").first()["df"] == n
        assert index.postings.count() == index.blocks.agg(F.sum("n")).first()[0]


def test_blocks_across_batches(spark, tmp_path, monkeypatch):
    """Rows of a block that come in several Arrow batches; rows that come twice; terms cut by range."""
    monkeypatch.setattr(IX, "SLICE_CHUNKS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(d // 2, 0, f"f{d // 2}.txt", " ".join(["often"] * (1 + d % 3) + [f"w{d % 9}"])) for d in range(400)]
        chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, source_filename string, content string")
        index = IX.write_index(chunks, str(tmp_path / "i"), KEYS)
        got = {(r.term, r.doc_id, r.dl, r.tf, r["count"]) for r in index.postings.groupBy("term", "doc_id", "dl", "tf").count().collect()}
        want = {}
        for d, _, _, text in rows:
            for w in set(text.split()):
                k = (w, d, len(text.split()), text.split().count(w))
                want[k] = want.get(k, 0) + 1
        assert got == {(*k, n) for k, n in want.items()}
        tops = index.blocks.select("term", F.array_sort("tops").alias("t"), "entries").collect()
        for r in tops:
            least = {}
            for e in r.entries:
                least[e.tf] = min(least.get(e.tf, e.dl), e.dl)
            assert [(x.tf, x.dl) for x in r.t] == sorted(least.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_blocks_and_texts_meet_few_rows_in_place(spark, index, capsys):
    """The terms of a batch, a file's ranges and the ranked chunks are broadcast: no block and no text is shuffled."""
    from corpuskit.plans.search import with_chunks

    q = spark.createDataFrame([(1, "w7 w1500", None), (2, "hot", "f3.txt")], "query_id long, query string, wanted string")
    best = R.bm25_topk(index, q, KEYS, 2)
    rows = with_chunks(index, best)
    for df in (R.bm25_search(index, q, KEYS), R.bm25_search(index, q, KEYS, wanted_file="wanted"), rows):
        df.explain("simple")
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows.select("query_id", "rank", "content").count() == 4 == rows.filter("content IS NOT NULL").count()
