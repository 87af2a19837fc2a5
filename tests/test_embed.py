"""Corpus-fitted embedder and domain lists on small rows."""

import hashlib
import math

from pyspark.sql import functions as F

from corpuskit.operators import embed as E


def vector(text, df, n, dim):
    v = [0.0] * dim
    for w in text.split():
        if w in df:
            h = hashlib.md5(w.encode()).hexdigest()
            weight = math.log((1 + n) / (1 + df[w])) + 1
            v[int(h[:8], 16) % dim] += weight if int(h[8], 16) % 2 == 0 else -weight
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm if norm else 0.0 for x in v]


def test_chunks_and_queries_share_the_fitted_weights(spark):
    texts = ["apple banana apple", "cherry banana", "banana", "", "apple dates figs grapes"]
    df = {}
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    fitted = E.fit(spark.createDataFrame(list(df.items()), "term string, df long"), F.lit(len(texts)), dim=8)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "unknown words", None, "banana apple apple"])],
                                 "id long, text string")
    got = {r["id"]: r["embedding"] for r in E.embed_texts(rows, "text", fitted, ["id"], dim=8).collect()}
    assert len(got) == 8
    for r in rows.collect():
        want = vector(r["text"] or "", df, len(texts), 8)
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[r["id"]], want)) and len(got[r["id"]]) == 8
    # rarer terms weigh more
    weights = {r["term"]: abs(r["weight"]) for r in fitted.collect()}
    assert weights["figs"] > weights["apple"] > weights["banana"]


def test_domain_lists_equal_the_compiled_filter(spark):
    from corpuskit.plans.urls import domain_filter, domain_lists
    urls = ["https://example.com/a", "http://blog.Example.com", "http://notexample.com", "http://a.b.example.org:80/x", "ftp://x.net",
            "nonsense", "", "http://com", "http://u@x.net/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None])], "id long, url string")
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "domain string")
    for inc, exc in ((["example.com", "example.org"], ["blog.example.com"]), (["EXAMPLE.com"], None), (None, ["example.org", "x.net"]),
                     (["com"], ["example.com"]), (["x.net", None, ""], None), ([], []), (["nowhere"], None)):
        low = lambda xs: [x.lower() for x in xs or [] if x]
        want = domain_filter(df.filter("url IS NOT NULL"), low(inc), low(exc))
        got = domain_lists(df.filter("url IS NOT NULL"), table(inc) if inc is not None else None, table(exc) if exc is not None else None)
        assert sorted(got.collect()) == sorted(want.collect()), (inc, exc)
