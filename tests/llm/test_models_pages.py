"""Pseudo-likelihood, nearest neighbours, page text, and the registered queries."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from corpuskit.llm import lm, neighbours, pages
from oracle import compare, duck

SMALL = "/root/testdata/sf0.001"


def plain_triples(texts, words):
    encode, out = lm.classifier(words), {}
    for t in texts:
        x = encode(t).tolist()
        for a, b, c in zip(x, x[1:], x[2:]):
            code = (a * lm.CLASSES + c) * lm.CLASSES + b
            out[code] = out.get(code, 0) + 1
    return out


def test_triples_cover_all_documents(docs, texts):
    words = lm.vocabulary(docs)
    got = {r["code"]: r["n"] for r in lm.triples(docs, words).collect()}
    assert got == plain_triples([t for _, t in texts], words)
    assert len(words) == lm.CLASSES - 1 - lm.SHAPES - lm.ENDS and len(set(words)) == len(words)


def test_scores_are_sums_of_conditional_log_probabilities(docs, texts):
    words = lm.vocabulary(docs)
    counts = plain_triples([t for _, t in texts], words)
    codes = np.array(sorted(counts))
    net = lm.fit(codes, np.array([counts[c] for c in codes.tolist()]), steps=20)
    got = {r["doc_id"]: r for r in lm.score(docs, words, net.table()).collect()}
    encode = lm.classifier(words)
    for doc, text in texts[:25]:
        x = encode(text)
        _, logp = net.forward(x[:-2], x[2:])
        want = float(logp[np.arange(len(x) - 2), x[1:-1]].sum())
        assert got[doc]["n_tokens"] == len(x) - 2
        assert got[doc]["log_likelihood"] == pytest.approx(want, rel=1e-4)


def test_gradient_and_held_out_accuracy(texts):
    """Both sides tell more than frequencies do, on documents kept out of training."""
    own, other = [t for i, t in texts if i % 2], [t for i, t in texts if not i % 2]
    from collections import Counter
    top = [w for w, _ in Counter(w.lower() for t in own for w in t.split()).most_common(lm.CLASSES - 1 - lm.SHAPES - lm.ENDS)]
    counts = plain_triples(own, top)
    codes = np.array(sorted(counts))
    net = lm.WindowNetwork()
    context, token = np.divmod(codes, lm.CLASSES)
    used, row = np.unique(context, return_inverse=True)
    table = np.zeros((len(used), lm.CLASSES))
    table[row, token] = [counts[c] for c in codes.tolist()]
    course = net.train(*np.divmod(used, lm.CLASSES), table, steps=150)
    assert course[-1] < course[0]
    once = table.sum(axis=0) + 0.1
    once = np.log(once / once.sum())
    held = plain_triples(other, top)
    logp = net.table()
    both = sum(n * logp[c] for c, n in held.items()) / sum(held.values())
    alone = sum(n * once[c % lm.CLASSES] for c, n in held.items()) / sum(held.values())
    assert both > alone + 0.05


def test_pseudo_likelihood_awkward(awkward, nothing):
    rows = lm.pseudo_likelihood(awkward).collect()
    assert len(rows) == awkward.count() and lm.pseudo_likelihood(nothing).count() == 0
    blank = [r for r in rows if r["doc_id"] in (2, 3, 4)]
    assert all((r["n_tokens"], r["log_likelihood"], r["mean_log_likelihood"]) == (0, 0.0, None) for r in blank)


@pytest.mark.parametrize("frequent", [0, 3, lm.FREQUENT])
def test_every_token_has_its_own_probability(spark, frequent):
    """Tokens without a class of their own are told apart by their counts, joined or carried along."""
    common = " ".join(f"w{i}ord" for i in range(lm.CLASSES)) + " the the "
    ends = ["horse", "horse", "horse", "glorse", "glorse", "xqrse", "Horse", ""]
    rows = [(i, common * 3 + w) for i, w in enumerate(ends)] + [(1, common * 3 + "horse"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.pseudo_likelihood(df, frequent=frequent).collect()
    assert len(got) == len(rows)
    ll = {r["doc_id"]: r["log_likelihood"] for r in got}
    assert ll[0] == ll[1] == ll[2] and ll[3] == ll[4]
    assert ll[0] - ll[3] == pytest.approx(math.log(4 / 2), abs=1e-6)
    assert ll[3] - ll[5] == pytest.approx(math.log(2 / 1), abs=1e-6) and ll[5] == ll[6]
    if frequent != lm.FREQUENT:
        want = {r["doc_id"]: r["log_likelihood"] for r in lm.pseudo_likelihood(df).collect()}
        assert all(ll[d] == pytest.approx(want[d], abs=1e-6) for d in want)


def test_token_shares_sum_to_one_in_a_class(docs, texts):
    from collections import Counter
    words = lm.vocabulary(docs)
    total = Counter(w for _, t in texts for w in (t or "").encode().split())
    shares = lm.token_shares(lm.token_counts(docs), words).collect()
    assert {r["w"].encode(): r["n"] for r in shares} == total
    sums = Counter()
    for r in shares:
        sums[r["class"]] += math.exp(r["units"] * lm.UNIT)
    assert all(v == pytest.approx(1, abs=1e-6) for v in sums.values())


def plain_top(rows, queries, k):
    out = {}
    for qi, q in queries:
        s = [(-float(np.sum(np.array(v) * np.array(q))), i) for i, v in rows if i != qi and len(v) == len(q)]
        out[qi] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def vectors(rng, n, d, centres=0):
    c = rng.normal(size=(centres, d)) * 3 if centres else None
    return [(i, (rng.normal(size=d) + (c[i % centres] if centres else 0)).tolist()) for i in range(n)]


@pytest.mark.parametrize("centres, block, sample", [(0, 16_384, 20_000), (12, 64, 100)])
def test_neighbours_recall(spark, centres, block, sample):
    rows = vectors(np.random.default_rng(4), 1500, 24, centres)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.top_k(df, df.filter("vec_id % 20 = 0"), block=block, sample=sample, queries_at_once=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = plain_top(rows, [x for x in rows if x[0] % 20 == 0], 20)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hit >= 0.9 * 20 * len(want)
    exact = {(q, i): s for q, top in want.items() for i, s in top}
    for q, top in got.items():
        assert sorted(top) == list(range(1, 21)) and q not in {i for i, _ in top.values()}
        for i, s in top.values():
            assert s == pytest.approx(exact.get((q, i), s), rel=1e-12)


def test_neighbours_ties_and_invalid(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(50)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]),
            (104, [math.nan, 1.0, 1.0]), (105, [math.inf, 1.0, 1.0]), (106, [1.0, 1.0]), (107, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string")
    got = {}
    for r in neighbours.top_k(df, df.filter("vec_id % 20 = 0 or vec_id = 106"), k=5, block=8, sample=10, queries_at_once=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40}  # 100 is null, 106 has no partner of its length
    assert sorted(got[0]) == [(j, j, 14.0) for j in range(1, 6)]
    assert sorted(got[20]) == [(j + 1, j, 14.0) for j in range(5)]
    few = neighbours.top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 1), (2, 2)]
    assert neighbours.top_k(df.limit(0), df.limit(0)).count() == 0
    twice = neighbours.top_k(df.union(df).filter("vec_id < 3"), df.filter("vec_id = 0")).collect()
    assert sorted(r["vec_id"] for r in twice) == [1, 1, 2, 2]


@pytest.mark.parametrize("block", [2, 16_384])
def test_neighbours_of_a_length_that_the_sample_lacks(spark, block):
    rng = np.random.default_rng(6)
    rows = vectors(rng, 40, 3) + [(100 + i, v) for i, v in vectors(rng, 6, 2)] + [(200 + i, v) for i, v in vectors(rng, 5, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.top_k(df, df, k=3, probability=0.999999, block=block, sample=1, queries_at_once=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = plain_top(rows, rows, 3)
    assert {q: [got[q][j] for j in sorted(got[q])] for q in got} == {q: [i for i, _ in top] for q, top in want.items()}


def test_chi_square_quantile():
    # table values for 2 and 8 degrees of freedom
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="home">
<header class="site-header"><h1>Site</h1><nav><ul><li>A<li>B</ul></nav></header><div class="cookie-notice">Cookies <b>ok</b></div>
<div id="sidebar"><div>side</div><p>x</div>{open}<article class="post"><header><h1>Real &amp; title</h1></header>
<p>First <b>para</b>graph
 with  space.<p>Second &lt;tag&gt; 3 < 4 &eacute;.</p><div class="ad-slot"><p>Buy now</p></div><form>Name <input type=text></form>
<p class=share>Share this<p>Third.</p></article><section id="comments"><p>Nice!</p></section><footer>F</footer>
<script>var a="</p><p>x";</script></body></html>"""


def test_article_without_furniture():
    got = [x for x, *_ in pages.lines(PAGE.format(open="<div>Outside</div>"))]
    assert got == ["Real & title", "First paragraph with space.", "Second <tag> 3 < 4 é.", "Third."]
    assert pages.lines(None) == [] and pages.lines("") == []
    assert [x for x, *_ in pages.lines("plain text only")] == ["plain text only"]


def test_shared_is_a_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.permutation(12)[:8].tolist(), rng.permutation(12)[:9].tolist()
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pages.shared(a, b)
        assert len(got) == best[-1][-1] and got == sorted(got)
        places = [b.index(a[i]) for i in got]
        assert places == sorted(places)
    assert pages.shared([1, 1, 2], [1, 2, 2]) == [0, 2] and pages.shared([], [1]) == []


def test_differencing_deletes_what_neighbours_share(spark):
    """Pages without an article element: the host's lines go, copies and passages stay."""
    def page(i, host="h.example"):
        return (i, f"http://{host}/a/{i}", f"<body><div>Welcome to our site</div><p>Text {i} is long enough to outweigh "
                   f"the lines that all pages of this host share, {i}.</p><div>Call us today</div></body>")

    rows = [page(i) for i in range(10, 20)] + [page(5, "other.example")]
    rows += [(30, "http://copy.example/x", rows[0][2]), (31, "http://copy.example/y", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10, 20):
        assert got[i].startswith(f"Text {i} is") and "\n" not in got[i]
    assert got[5].count("\n") == 2  # no neighbour on its host
    assert got[30].count("\n") == got[31].count("\n") == 2  # copies of each other


def test_pages_awkward(spark):
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "http://a/b", ""), (3, "http://a/c", long), (3, "http://a/c", long), (None, "x", "<p>t</p>"), (3, "http://a/c", "<p>u")]
    df = spark.createDataFrame([(*r, "?", "!") for r in rows], "page_id long, url string, html string, text string, host string")
    got = pages.main_text(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 249_999), (3, 249_999)]
    assert pages.main_text(df.limit(0)).count() == 0


NAMES = sorted(n for n in entry.queries() if n == "pipeline" or n[:2] == "op" and n[2].isdigit())


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(NAMES[:-1], key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert NAMES[-1] == "pipeline"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql().keys() & set(NAMES)))
def test_oracles(spark, name):
    for d in (SMALL, "/root/testdata/sf0.01"):
        got = compare(entry.queries()[name](spark, d), entry.oracle_sql()[name], duck(d))
        assert got["ok"], got
