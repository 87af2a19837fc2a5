"""Request rules, alpha rule, and top-k against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from corpuskit.operators import retrieval as R
from corpuskit.functions.text import STOP_WORDS


def test_pick_alpha(spark):
    cases = {"CPAP.pdf": 0.0, '"exact phrase match"': 0.0, '"': 0.0, "two words": 0.3,
             "one two three four five six seven eight nine ten": 0.7, "a b c": 0.3}
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    got = {r.q: r.a for r in df.select("q", R.pick_alpha("q").alias("a")).collect()}
    assert got == cases


def test_validate_request(spark):
    rows = [("q", None, None, None), ("q", "3", None, None), ("q", "true", None, None), ("q", "26", None, None),
            ("q", "0", None, None), ("q", None, "smart", None), ("q", None, "invalid", None),
            ("q", None, " RAW ", "both"), ("   ", "3", None, None)]
    df = spark.createDataFrame(rows, "query string, top_k string, mode string, response_mode string")
    out = R.validate_request(df).collect()
    assert [(r.k, r.resolved_mode) for r in out[:2]] == [(5, "synthesis"), (3, "synthesis")]
    assert out[2].error.startswith("Invalid top_k type")
    assert out[3].error.startswith("Invalid top_k value") and out[4].error.startswith("Invalid top_k value")
    assert out[5].resolved_mode == "synthesis" and out[6].error.startswith("Invalid response_mode")
    assert out[7].resolved_mode == "both"
    assert out[8].error == "Empty query provided"


def test_bm25_brute_force(spark):
    docs = [(1, 0, "apple banana apple"), (2, 0, "banana cherry"), (3, 0, "the cherry apple pie"), (4, 0, "")]
    qs = [(10, "apple pie"), (11, "cherry")]
    c = spark.createDataFrame(docs, "doc_id long, chunk_index int, content string")
    q = spark.createDataFrame(qs, "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.bm25 for r in R.bm25_scores(c, q, ["doc_id", "chunk_index"]).collect()}
    toks = {d: [w for w in t.split() if w and w not in STOP_WORDS] for d, _, t in docs}
    n, avg = len(docs), sum(len(v) for v in toks.values()) / len(docs)
    want = {}
    for qid, text in qs:
        for term in set(text.split()):
            df_ = sum(term in v for v in toks.values())
            if not df_:
                continue
            idf = math.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
            for d, v in toks.items():
                tf = v.count(term)
                if tf:
                    want[(qid, d)] = want.get((qid, d), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / avg))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vector_topk_brute_force(spark):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(300, 16))
    queries = rng.normal(size=(7, 16))
    it = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "vec_id long, v array<double>")
    qs = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(queries)], "qid long, qv array<double>")
    got = R.vector_topk(it, qs, "vec_id", "v", "qid", "qv", k=4, item_block=64, query_block=3).collect()
    un = items / np.linalg.norm(items, axis=1, keepdims=True)
    for i, q in enumerate(queries):
        s = un @ (q / np.linalg.norm(q))
        best = sorted(range(len(s)), key=lambda j: (-round(s[j], 6), j))[:4]
        mine = [r.vec_id for r in sorted([r for r in got if r.qid == 100 + i], key=lambda r: (-round(r.score, 6), r.vec_id))]
        assert mine == best
        assert all(abs(r.vmax - s.max()) < 1e-9 and abs(r.vmin - s.min()) < 1e-9 for r in got if r.qid == 100 + i)


def test_vector_topk_without_vectors(spark):
    it = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, v array<float>")
    qs = spark.createDataFrame([(9, [1.0, 0.0]), (8, None), (7, [0.0, 2.0]), (6, [3.0, 0.0])], "qid long, qv array<float>")
    got = R.vector_topk(it, qs, "vec_id", "v", "qid", "qv", k=1, at_once=2).collect()
    assert sorted((r.qid, r.vec_id, r.score, r.vmin, r.vmax) for r in got) == [
        (6, 1, 1.0, 0.0, 1.0), (7, 3, 1.0, 0.0, 1.0), (9, 1, 1.0, 0.0, 1.0)]
    assert R.vector_topk(it.limit(0), qs, "vec_id", "v", "qid", "qv").count() == 0


def test_cosine_matches_numpy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 2.0, 1.0])], "a array<double>, b array<double>")
    v = df.select(R.cosine(F.col("a"), F.col("b")).alias("c")).first().c
    assert abs(v - 10 / 14) < 1e-12


def test_merged_hybrid_equals_full(spark, tables_small):
    from corpuskit.plans import search as S
    cols = ["query_id", "rank", "doc_id", "chunk_index"]
    for k in (1, 5, 60):
        full = {tuple(r) for r in S.hybrid_df(tables_small, k, merged=False).select(*cols, F.round("score", 6)).collect()}
        merged = {tuple(r) for r in S.hybrid_df(tables_small, k).select(*cols, F.round("score", 6)).collect()}
        assert full == merged and len(full) > 0


def test_threshold_merge_brute_force(spark):
    """Random lists: rows without a vector, alpha 0 and 1, equal scores; few pairs get a cosine."""
    rng = np.random.default_rng(8)
    nq, n, depth = 6, 900, 12
    b = {(q, d): float(np.round(rng.exponential(), 2)) for q in range(nq) for d in range(n) if rng.random() < 0.7}
    c = {(q, d): float(np.round(rng.normal(scale=0.2), 2)) for q in range(nq) for d in range(n) if d % 5}
    alpha = dict(enumerate([0.0, 0.3, 0.3, 0.7, 0.7, 1.0]))
    b = {k: v for k, v in b.items() if k[0] != 4}  # a query without keyword matches
    asked = []

    def cos_of(pairs):
        asked.append(pairs.count())
        return pairs.join(all_cos, ["q", "d"])

    all_cos = spark.createDataFrame([(*k, v) for k, v in c.items()], "q long, d long, cos double")
    bm = spark.createDataFrame([(*k, v) for k, v in b.items()], "q long, d long, bm25 double")
    low = {q: min(v for (p, _), v in c.items() if p == q) for q in alpha}
    high = {q: max(v for (p, _), v in c.items() if p == q) for q in alpha}
    al = spark.createDataFrame([(q, a, low[q] if a else None, high[q] if a else None) for q, a in alpha.items()],
                               "q long, alpha double, vmin double, vmax double")
    listed = R.top_k(all_cos.filter("q > 0"), "q", "cos", ["d"], depth)
    got = {(r.q, r["rank"], r.d, round(r.score, 6)) for r in R.hybrid_topk(R.TableScores(bm, ["d"], "q"), listed, cos_of, al, 4, depth).collect()}
    want = set()
    for q, a in alpha.items():
        bq = {d: v for (p, d), v in b.items() if p == q}
        span = (max(bq.values()) - min(bq.values())) if bq else 1
        rows = []
        for d in range(n):
            nb = (bq[d] - min(bq.values())) / span if d in bq else 0.0
            nv = (c[q, d] - low[q]) / (high[q] - low[q]) if (q, d) in c else 0.0
            if d in bq or (a and (q, d) in c):
                rows.append((-round(nb if a == 0 else a * nv + (1 - a) * nb, 6), d))
        want |= {(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(rows)[:4])}
    assert got == want
    assert sum(asked) < len(b) / 10


def test_index_search_with_file_names(spark, tmp_path):
    from corpuskit.operators.index import write_index
    docs = [(1, 0, "a.txt", "apple banana"), (2, 0, "b.txt", "apple pie"), (3, 0, "c.txt", ""), (4, 0, None, "apple")]
    c = spark.createDataFrame(docs, "doc_id long, chunk_index int, source_filename string, content string")
    q = spark.createDataFrame([(10, "apple", None), (11, "apple", "b.txt"), (12, "apple", "no.txt"), (13, "banana", "b.txt")],
                              "query_id long, query string, wanted string")
    keys = ["doc_id", "chunk_index"]
    index = write_index(c, str(tmp_path / "index"), keys)
    plain = {(r.query_id, r.doc_id): r.bm25 for r in R.bm25_scores(c, q, keys).collect()}
    got = {(r.query_id, r.doc_id): r.bm25 for r in R.bm25_search(index, q, keys, wanted_file="wanted").collect()}
    assert set(got) == {(10, 1), (10, 2), (10, 4), (11, 2)}
    assert all(abs(got[k] - plain[k]) < 1e-12 for k in got)      # scores are those of the whole collection


def test_searches_read_the_stored_index(spark, tables_small):
    import contextlib
    import io
    from corpuskit.plans import search as S
    first = S.search_index(tables_small)
    assert S.search_index(tables_small) is first                 # the same files: written once
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        S.hybrid_df(tables_small, merged=False).explain("simple")
    assert "documents.parquet" not in out.getvalue() and "search-index-" in out.getvalue()
