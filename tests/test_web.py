"""Page-text join fallbacks (reference rules) and fusion."""

from corpuskit.operators import web


def test_join_content_fallbacks(spark):
    hits = spark.createDataFrame(
        [(1, "p", 0, "T1", "https://a", "snippet a", 0.9), (1, "p", 1, None, "https://b", "snippet b", 0.8),
         (1, "p", 2, "T3", "", "no url", 0.7), (1, "p", 3, "T4", "https://c", "snippet c", 0.6)],
        "query_id long, provider string, rank long, title string, url string, content string, score double")
    pages = spark.createDataFrame(
        [(1, "https://a", "full a"), (2, "https://b", "   "), (3, None, "orphan"), (4, "https://c", None),
         (5, "https://a", "full a later")], "page_id long, url string, text string")
    got = {r.url: (r.title, r.content) for r in web.join_content(hits, pages).collect()}
    assert got == {"https://a": ("T1", "full a later"), "https://b": ("Untitled", "snippet b"),
                   "https://c": ("T4", "snippet c")}


def test_fuse_keeps_best_score(spark):
    hits = spark.createDataFrame(
        [(1, "exa", 0, "u", "c", 0.5), (1, "tavily", 0, "u", "c", 0.9), (1, "brave", 0, "v", "d", None)],
        "query_id long, provider string, rank long, url string, content string, score double")
    got = web.fuse_sources(hits, {"exa": 0, "tavily": 1, "brave": 2}).orderBy("pos").collect()
    assert [(r.provider, r.score) for r in got] == [("tavily", 0.9), ("brave", None)]


def test_keyset_paging_matches_offset(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "k long")
    first = [r.k for r in web.page_after(df, "k", None, 10).collect()]
    second = [r.k for r in web.page_after(df, "k", first[-1], 10).collect()]
    offset = [r.k for r in web.page_results(df, ["k"], 10, 2).collect()]
    assert first == list(range(10)) and second == offset == list(range(10, 20))


def test_hits_without_text_stay_apart(spark):
    from corpuskit.operators.web import fuse_sources
    rows = [(1, "p", 1, "u", None, 0.5), (1, "p", 2, "u", None, 0.4), (1, "q", 1, None, None, 0.3),
            (1, "p", 3, "v", "same", 0.2), (1, "q", 2, "v", "same", 0.9)]
    df = spark.createDataFrame(rows, "query_id int, provider string, rank int, url string, content string, score double")
    got = fuse_sources(df, {"p": 0, "q": 1}).orderBy("pos").collect()
    assert [(r.provider, r.rank) for r in got] == [("q", 2), ("p", 1), ("p", 2), ("q", 1)]


def test_iso_bounds(spark):
    from pyspark.sql import functions as F
    from corpuskit.operators.activity import normalize_bound
    texts = {"2024-01-01T10:00:00.500Z": "10:00:00.5", "2024-01-01T10:00:00.500000+00:00": "10:00:00.5",
             "2024-01-01 10:00:00": "10:00:00", "2024-01-01T10:00": "10:00:00", "2024-01-01T10:00+02:00": "08:00:00",
             "2024-01-01": "00:00:00", "2024": None, "soon": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in df.select("t", normalize_bound(F.col("t")).cast("string").alias("v")).collect()}
    assert got == {t: v and f"2024-01-01 {v}" for t, v in texts.items()}


def test_unreadable_store_is_not_an_empty_one(spark, tmp_path):
    import pytest
    from corpuskit.operators.store import chunk_table, replace_files
    path = str(tmp_path / "store")
    chunks = lambda name: spark.createDataFrame([(name, "text", 0)], "source_filename string, content string, chunk_index int")
    replace_files(spark, path, chunks("x"))
    m = chunk_table(spark, path).manifest()
    [(depth, bits, folder, _)] = m.buckets
    broken = tmp_path / "store" / "data" / folder / f"depth={depth}" / f"bits={bits}" / "part-99999-broken.parquet"
    broken.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        replace_files(spark, path, chunks("y"))
    assert chunk_table(spark, path).manifest().buckets == m.buckets
    broken.write_bytes(b"")
    kept = [f for f in broken.parent.iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert kept and spark.read.parquet(*map(str, kept)).select("source_filename").collect()[0][0] == "x"


def test_source_mix_shuffles_no_texts(spark):
    """Only URLs of pages with text meet the hits, and the counts are those of the joined texts."""
    from corpuskit.operators import web
    raw = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("a", None), ("b", "u1"), ("b", "u3"), ("c", "u1")], "provider string, url string")
    kept = raw.filter("provider <> 'c' AND url IS NOT NULL")
    pages = spark.createDataFrame([(1, "u1", "text"), (2, "u1", " "), (3, "u2", " \n"), (4, "u3", None), (None, "u3", "x"), (5, "", "y"), (6, None, "z")],
                                  "page_id long, url string, text string")
    out = web.source_mix(raw, kept, pages)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 3, 2, 1, 1), ("b", 2, 2, 0, 1)]
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
