"""Hard negatives: bounds, exact integers, and the job against brute force."""

import math

import numpy as np
import pytest

from corpuskit.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, size string, cell string, score string, part string, z string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def plain(rows, anchors):
    """Every pair in Python integers."""
    ok = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows
          if i is not None and k is not None and v is not None
          and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    chosen = {}
    for i, v, k in ok:
        if i in anchors:
            chosen[i] = min(chosen.get(i, (k, v)), (k, v))
    out = []
    for i, (k, v) in chosen.items():
        others = sorted(((-max(min(sum(map(lambda a, b: a * b, v, w)), 2 ** 63 - 1), -2 ** 63), j, m) for j, w, m in ok
                         if j != i and len(w) == len(v)))
        for s, j, _ in [x for x in others if x[2] == k][:5]:
            fits = [(t, n) for t, n, m in others if m != k and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, anchors, **how):
    df = frame(spark, rows)
    got = negatives.mine(df, df.filter(df.vec_id.isin(list(anchors))), **how)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                               "negative_score").collect())


@pytest.mark.parametrize("d", [1, 3, 4, 7, 64, 130])
def test_bounds_hold_at_every_level_and_tighten(d):
    rng = np.random.default_rng(d)
    x, y = np.floor(256 * rng.normal(size=(60, d))), np.floor(256 * rng.normal(size=(80, d)) + 40)
    exact, last = negatives.scores(x, y), None
    for a, b in zip(negatives.levels(*negatives.summary(x)), negatives.levels(*negatives.summary(y))):
        low, high = negatives.bounds(a, b)
        assert (low <= exact).all() and (exact <= high).all()
        assert last is None or (high - low).mean() <= last * (1 + 1e-9)
        last = (high - low).mean()
    sizes = negatives.summary(x)[2]
    coarse = negatives.levels(*negatives.summary(x))[0][0]
    assert coarse.shape[1] <= negatives.MERGED and sizes.sum() == d


def test_scores_beyond_doubles_are_exact():
    q = np.array([[2.0 ** 40, 3.0], [2.0 ** 60, 1.0], [1.0, 2.0]])
    z = np.array([[2.0 ** 20, 5.0], [2.0 ** 30, -1.0], [7.0, 7.0]])
    assert negatives.scores(q, z).tolist() == [[2 ** 60 + 15, 2 ** 63 - 1, 7 * 2 ** 40 + 21],
                                               [2 ** 63 - 1, 2 ** 63 - 1, 7 * 2 ** 60 + 7], [2 ** 20 + 10, 2 ** 30 - 2, 21]]


def test_windows_of_all_signs():
    for p in [*range(-500, 500), 2 ** 63 - 1, -2 ** 63]:
        low, high = (int(x) for x in negatives.windows(np.array(p, dtype=np.int64)))
        assert low == -(-50 * p // 100) and high == 95 * p // 100


def test_equals_brute_force_on_clustered_rows_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 20))
    rows = []
    for i in range(700):
        v = centres[i % 9] + 0.6 * rng.normal(size=20)
        # one label holds a third of the rows; components on a grid, so scores tie
        rows.append((i, (np.round(v * 4) / 4).tolist(), 0 if i % 3 == 0 else int(rng.integers(1, 6))))
    anchors = set(range(0, 700, 10))
    want = plain(rows, anchors)
    assert len(want) > 500
    assert mined(spark, rows, anchors, block=50, sample=200) == want
    assert mined(spark, rows, anchors) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [0.2, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.8, 0.1], 2), (2, [0.8, 0.1], 2), (3, [0.7, 0.0], 2),
            (4, [0.6, 0.5], 3), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 1.0], None),
            (None, [1.0, 1.0], 1), (10, [1e306, 1.0], 2), (11, [], 1), (12, [], 1), (13, [], 2), (14, [1.0], 1), (15, [1.0], 2),
            (16, [0.0, 0.0], 1), (17, [-1.0, -0.5], 1), (18, [1e12, 1e12], 1), (19, [1e12, 1e11], 1), (20, [9e11, 1e12], 2),
            (21, [1e200, 0.0], 4), (22, [1.0, 0.0], 4), (23, [0.7, 0.3], 5)]
    anchors = {r[0] for r in rows if r[0] is not None}
    assert mined(spark, rows, anchors) == plain(rows, anchors)
    assert mined(spark, rows, anchors, block=2, sample=4) == plain(rows, anchors)
    assert mined(spark, [], set()) == [] and mined(spark, [(1, None, 1)], {1}) == []


def test_cells_out_of_reach_are_left_out(spark):
    """Far clusters get no anchors: their boxes bound every score below the wanted ones."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        v = np.zeros(32)
        v[(i % 4) * 8:(i % 4) * 8 + 8] = 1.0
        rows.append((i, (v + 0.01 * rng.normal(size=32)).tolist(), int(rng.integers(0, 3))))
    found = []
    keep = negatives._meet

    def counted(blocks, asked, keys, k, same):
        if not same:
            found.append((asked.count(), blocks.select(*keys).distinct().count()))
        return keep(blocks, asked, keys, k, same)

    negatives._meet = counted
    try:
        assert mined(spark, rows, set(range(0, 600, 20)), block=40, sample=600) == plain(rows, set(range(0, 600, 20)))
    finally:
        negatives._meet = keep
    routed, blocks = found[0]
    assert routed <= 30 * blocks / 2
