"""Set-similarity join and components against brute force, with the registered settings."""

import random

import numpy as np
import pytest

from corpuskit.functions.text import STOP_WORDS
from corpuskit.operators import setjoin as S
from corpuskit.operators.components import components


def brute(rows, limit):
    """(classes, links) by comparing every pair of token sets."""
    sets = {k: frozenset(w for w in (t or "").lower().split() if w not in STOP_WORDS) for k, t in rows if k is not None}
    sets = {k: s for k, s in sets.items() if s}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys, links = sorted(sets), set()
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            shared = len(sets[a] & sets[b])
            if 1 - shared / (len(sets[a]) + len(sets[b]) - shared) <= limit + 1e-9:
                links.add((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k)
    return {(k, r, len(m)) for r, m in groups.items() if len(m) > 1 for k in m}, links


def corpus(seed, n=700):
    """Texts, chains of edited copies, one large group of near copies, short and odd texts."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(900)]
    weight = [1 / (i + 1) ** 0.7 for i in range(len(vocab))]
    texts = [rng.choices(vocab, weight, k=rng.choice([2, 5, 12, 40, 90])) for _ in range(n // 2)]
    while len(texts) < n:
        t = list(rng.choice(texts[:200] if rng.random() < 0.6 else texts[:1]))
        for _ in range(rng.randint(0, max(1, len(t) // 4))):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "the of and"), (n + 3, "alone"), (n + 4, "alone"), (n + 5, "Alone alone")]


@pytest.mark.parametrize("seed, limit, how", [
    (1, 0.3, {}), (2, 0.5, {"block": 8, "frequent": 50}), (3, 0.0, {"frequent": 0})])
def test_classes_equal_brute_force(spark, monkeypatch, seed, limit, how):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "id long, text string")
    seen, real = [], S.links
    monkeypatch.setattr(S, "links", lambda *a: seen.append(real(*a)) or seen[0])
    got = {tuple(r) for r in S.near_duplicate_classes(df, "id", "text", limit, **how).collect()}
    want, links = brute(rows, limit)
    assert got == want and len(want) > 20
    pairs = [(r["a"], r["b"]) for r in seen[0][1].collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= links


def test_a_large_group_is_not_listed_pair_by_pair(spark):
    """2,000 near copies: links found stay near their number, not its square."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(base, 56) + [f"own{i}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, text string")
    members, found, classes = S.links(df, "id", "text", 0.3)
    assert found.count() < 40 * len(rows)
    assert {r["root"] for r in classes.collect()} == {0} and classes.count() == 2000 == members.count()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert S.near_duplicate_classes(df, "id", "text").count() == 0
    assert S.near_duplicate_classes(spark.createDataFrame([(1, "one text")], df.schema), "id", "text").count() == 0


def test_components_of_random_graphs_and_a_long_chain(spark):
    rng = random.Random(1)
    for links in ([(i, i + 1) for i in range(300)], [(rng.randrange(200), rng.randrange(200)) for _ in range(140)],
                  [(0, i) for i in range(1, 400)], [(5, 5), (None, 3), (7, None)], []):
        root = {}

        def find(k):
            while root.setdefault(k, k) != k:
                k = root[k]
            return k

        for a, b in links:
            if a is not None and b is not None and a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
        assert sorted((r["vertex"], r["root"]) for r in got) == sorted((k, find(k)) for k in root)


def test_prefix_rows_are_narrow_and_few_whole_sets_are_shuffled(spark, monkeypatch):
    """Rows of prefix tokens hold token, place, key and size only; of many candidates hardly any reach the whole sets."""
    rng = random.Random(4)
    rows = []
    for g in range(30):  # the texts of a group share their rarest tokens and half of the others
        rare, half = [f"r{g}x{i}" for i in range(12)], rng.sample(range(400), 60)
        rows += [(20 * g + i, " ".join([*rare, *(f"c{v}" for v in half), *(f"c{v}" for v in rng.sample(range(400), 60))])) for i in range(20)]
    seen, real = {}, S._compared

    def compared(pairs, sets, made, most, check, schema):
        seen[most] = seen.get(most, 0) + pairs.count()
        return real(pairs, sets, made, most, check, schema)

    monkeypatch.setattr(S, "_compared", compared)
    df = spark.createDataFrame(rows, "id long, text string")
    sets = S._sets(df, "id", "text")
    assert S.prefixes(sets, 0.7, S._frequent(sets, 100)).columns == ["token", "pos", "key", "size"]
    got = {tuple(r) for r in S.near_duplicate_classes(df, "id", "text", 0.3).collect()}
    assert got == brute(rows, 0.3)[0]
    assert seen[S.SKETCHED] > 500 and seen[S.VERIFY] * 10 < seen[S.SKETCHED]


def test_sketches_lose_no_similar_pair():
    """Class counts bound what two sets share, also where a class is fuller than a byte can say."""
    rng = np.random.default_rng(5)
    shared = rng.integers(-2**62, 2**62, 700)
    crowded = np.arange(300, dtype=np.int64) << 40  # all in one class
    sets = [np.unique(np.concatenate([x, rng.integers(-2**62, 2**62, n)])) for x in (shared, shared[:500], crowded) for n in (20, 150, 600)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in sets])])
    counts = S.class_counts(at, np.concatenate(sets))
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    for least in (0.3, 0.7, 1.0):
        kept = S.may_be_similar(counts, np.diff(at), x, y, least)
        true = S.similar(sets, x, y, least) >= 0
        assert true.any() and not (true & ~kept).any()
    assert not S.may_be_similar(counts, np.diff(at), np.array([0]), np.array([8]), 0.7).any()


def _packed(sets, least, roots=None):
    """Sets by key as ``candidates`` has them, tokens in one order for all."""
    import pyarrow as pa

    keys = sorted(sets)
    made = [np.array(sorted(sets[k])[:S.prefix_length(len(sets[k]), least, S.SHARED)], dtype=np.int32) for k in keys]
    return {"key": pa.array(keys), "size": pa.array([len(sets[k]) for k in keys], pa.int32()),
            "root": pa.array([(roots or {}).get(k, k) for k in keys]), "length": pa.array([len(t) for t in made], pa.int32()),
            "token": pa.array(np.concatenate(made))}


@pytest.mark.parametrize("least, step", [(0.7, 5), (0.5, 2_000_000), (1.0, 1)])
def test_candidates_lose_no_similar_pair(monkeypatch, least, step):
    monkeypatch.setattr(S, "STEP", step)
    monkeypatch.setattr(S, "X_SETS", 40)
    rng = random.Random(6)
    sets = {}
    for k in range(260):  # sets of 1 to 60 tokens, and edited copies of others
        t = set(rng.choices(range(500), k=rng.randint(1, 60)))
        if k % 2 and sets:
            t = set(rng.choice(list(sets.values())))
            for _ in range(rng.randint(0, max(1, len(t) // 5))):
                t.discard(rng.choice(sorted(t)) if len(t) > 1 else None)
                t.add(rng.randrange(500))
        sets[f"k{k}"] = t
    roots = {k: "k1" for k in sorted(sets)[:60]}  # one large component
    x = _packed(sets, least, roots)
    names = x["key"].to_pylist()
    i, j = S.candidates(x, x, least)
    got = {frozenset((names[a], names[b])) for a, b in zip(i.tolist(), j.tolist())}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and roots.get(a, a) != roots.get(b, b)
            and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-9}
    assert len(got) == len(i) and want <= got and len(want) > 10
    assert not any(roots.get(a, a) == roots.get(b, b) for a, b in map(tuple, got))


def test_blocks_of_sizes_meet_all_that_can_be_similar():
    counts = [(1, 5), (2, 40), (3, 1), (10, 7), (14, 8), (15, 1), (100, 3), (1000, 2)]
    top, first, meets = S.size_blocks(counts, 10, 0.7)
    assert len(meets) == first[-1] and max(c for _, c in counts) > 10 and first[np.searchsorted(top, 2) + 1] - first[np.searchsorted(top, 2)] == 4
    for a, _ in counts:
        for b, _ in counts:
            if 0.7 * a <= b <= a:
                i, j = np.searchsorted(top, a), np.searchsorted(top, b)
                assert set(range(first[j], first[j + 1])) <= set(meets[first[i]])


def test_a_few_rare_tokens_in_common_make_no_candidate(spark, monkeypatch):
    """Unlike texts of 100 words that share five rare ones: counted in one task, never compared."""
    rng = random.Random(8)
    rows = [(i, " ".join([f"r{i // 20}x{k}" for k in range(5)] + [f"c{v}" for v in rng.sample(range(3000), 95)])) for i in range(400)]
    seen, real = [], S._compared

    def compared(pairs, *args):
        seen.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(S, "_compared", compared)
    assert S.near_duplicate_classes(spark.createDataFrame(rows, "id string, text string"), "id", "text").count() == 0
    # the first of the two joins compares every text with one other a token at most, as before; the second one none
    assert seen[2] == 0 and len(seen) == 4
