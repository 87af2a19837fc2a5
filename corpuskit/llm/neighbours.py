"""Approximate nearest neighbours: stable projections in a kd-tree, verified
until a chi-square test stops the search.

Inner product is turned into distance by one more coordinate that lifts every
vector to the largest norm M: |x' - q'|^2 = M^2 + |q|^2 - 2 <x, q>. A Gaussian
(2-stable) projection to m dimensions keeps distances in this sense: projected
over true squared distance is chi-square with m degrees of freedom. So once
the next projected neighbour lies at a squared distance above
``quantile(p) * d_k^2``, a true neighbour nearer than the k-th found so far is
left out with probability below 1 - p, and the search stops.

* Cells: a kd-tree over the projections of a bounded sample (``sample`` rows)
  cuts the space into cells; every row is put into its cell. A cell with more
  than ``block`` rows is dealt into blocks by a hash of the id, so a vector
  that very many rows share is spread as well.
* First pass: each query searches its own block, which bounds its k-th
  distance. Second pass: it goes to those cells alone whose bounding box of
  projections passes the test. A block builds a kd-tree over its projections;
  its leaves are taken nearest first and verified on the original vectors,
  the queries of a block side by side.
* A query's results of all blocks are merged by a top-k window, which is
  limited per task before the shuffle. Queries of one block are dealt into
  parts of at most ``queries_at_once``.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; only vectors of equal length meet; rows that repeat
an id are candidates of their own, never for a query of this id, and an id is
searched once, with its smallest vector; ties go to the smaller id; an empty
table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import materialize, stored

DIMENSIONS = 8
PROBABILITY = 0.98
SEED = 11


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees."""
    if m % 2 or m < 2:
        raise ValueError("an even number of dimensions is needed")
    half = m // 2

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings them to norm ``top``."""
    rest = np.sqrt(np.maximum(top ** 2 - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def projection(size: int, m: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size + 1, m))


class KdTree:
    """Median splits on the widest dimension down to leaves; boxes are tight."""

    def __init__(self, points: np.ndarray, leaf: int = 256):
        self.points = points
        self.nodes: list[tuple] = []  # (low, high, left, right) or (low, high, rows)
        self._build(np.arange(len(points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        own = self.points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        k = len(self.nodes)
        self.nodes.append(())
        wide = int(np.argmax(high - low))
        if len(rows) <= leaf or high[wide] == low[wide]:
            self.nodes[k] = (low, high, rows)
            return k
        order = np.argsort(own[:, wide], kind="stable")
        half = len(rows) // 2
        left = self._build(rows[order[:half]], leaf)
        right = self._build(rows[order[half:]], leaf)
        self.nodes[k] = (low, high, left, right)
        return k

    def leaves(self) -> list[tuple]:
        """(low, high, rows) of every leaf."""
        return [n for n in self.nodes if len(n) == 3]


def search_block(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray,
                 flat: np.ndarray, k: int, base: np.ndarray, quantile: float, bound: np.ndarray):
    """The k best (score, id) of a block for each of some queries.

    Every query takes the tree's leaves nearest first by projected distance;
    in each round the queries that are at the same leaf are verified together.
    A query is done when its next leaf fails the test. ``base`` is
    M^2 + |q|^2, ``bound`` the k-th squared distance known before; results
    beyond that bound are left out. Empty places have score -inf.
    """
    leaves = tree.leaves()
    gap = np.zeros((len(queries), len(leaves)))
    for j, (low, high, _) in enumerate(leaves):
        d = np.maximum(np.maximum(low - flat, flat - high), 0.0)
        gap[:, j] = (d * d).sum(axis=1)
    order = np.argsort(gap, axis=1, kind="stable")
    slack, bound = 1e-9 * base, bound.copy()  # slack: of the subtraction
    least = (base - bound - slack) / 2  # scores below are no news
    best_s = np.full((len(queries), k), -np.inf)
    best_i = np.full((len(queries), k), np.iinfo(np.int64).max)
    active = np.arange(len(queries))
    for turn in range(len(leaves)):
        at = order[active, turn]
        go = gap[active, at] <= quantile * (bound[active] + slack[active])
        active, at = active[go], at[go]
        if not len(active):
            break
        for j in np.unique(at).tolist():
            here, rows = active[at == j], leaves[j][2]
            # pair by pair alike (no blocked product), so equal vectors tie exactly
            score = np.einsum("qd,nd->qn", queries[here], vectors[rows])
            score[qids[here][:, None] == ids[rows][None, :]] = -np.inf
            score[score < np.maximum(best_s[here, -1], least[here])[:, None]] = -np.inf
            news = np.flatnonzero(np.isfinite(score).any(axis=1))
            if len(news):
                s = np.concatenate([best_s[here[news]], score[news]], axis=1)
                i = np.concatenate([best_i[here[news]], np.broadcast_to(ids[rows], (len(news), len(rows)))], axis=1)
                top = np.lexsort((i, -s), axis=1)[:, :k]
                best_s[here[news]] = np.take_along_axis(s, top, axis=1)
                best_i[here[news]] = np.take_along_axis(i, top, axis=1)
        full = np.isfinite(best_s[active, -1])
        done = active[full]
        bound[done] = np.minimum(bound[done], np.maximum(0.0, base[done] - 2 * best_s[done, -1]))
    return best_s, best_i


def _searcher(k: int, top: float, quantile: float, m: int):
    """Cogroup function: a block's rows and a part of the queries it gets."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if items.num_rows and queries.num_rows:
            ids, vectors = items["vec_id"].to_numpy(), matrix(items["v"])
            tree = KdTree(lifted(vectors, top) @ projection(vectors.shape[1], m))
            qids, q = queries["query_id"].to_numpy(), matrix(queries["v"])
            flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ projection(q.shape[1], m)
            bound = queries["bound"].fill_null(math.inf).to_numpy()
            s, i = search_block(tree, ids, vectors, qids, q, flat, k, top ** 2 + (q * q).sum(axis=1), quantile, bound)
            found = np.isfinite(s)
            cols = [np.repeat(qids, found.sum(axis=1)), i[found], s[found]]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return run


def _cells(tree_rows: np.ndarray, leaf: int) -> list[tuple]:
    """Splits of a kd-tree over the sample: (dimension, value, left, right) or a cell number."""
    nodes: list = []

    def build(x: np.ndarray) -> int:
        k = len(nodes)
        nodes.append(None)
        wide = int(np.argmax(x.max(axis=0) - x.min(axis=0))) if len(x) else 0
        value = float(np.median(x[:, wide])) if len(x) else 0.0
        right = x[:, wide] >= value if len(x) else np.zeros(0, dtype=bool)
        if len(x) <= leaf or right.all() or not right.any():
            nodes[k] = (k,)
            return k
        nodes[k] = (wide, value, build(x[~right]), build(x[right]))
        return k

    build(tree_rows)
    return nodes


def _cell_of(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if len(nodes[k]) == 1:
            out[rows] = k
        elif len(rows):
            wide, value, left, right = nodes[k]
            up = x[rows, wide] >= value
            todo += [(left, rows[~up]), (right, rows[up])]
    return out


def top_k(items: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          dimensions: int = DIMENSIONS, probability: float = PROBABILITY, block: int = 16_384, sample: int = 20_000,
          queries_at_once: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest, by inner product."""
    spark = items.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.filter(v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(
            F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))

    rows = valid(items)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.max(norm).alias("top"), F.count("*").alias("n")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], empty)
    top, n, m = math.sqrt(stats["top"]) * (1 + 1e-12), stats["n"], dimensions
    quantile = chi_square_quantile(probability, m)

    # the cells: splits fitted on a bounded sample (lowest hashes of the ids)
    seen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        seen.setdefault(len(r["v"]), []).append(r["v"])
    leaf = max(8, sample * block // max(n, sample) // 2)
    trees = {}
    for size, vectors in seen.items():
        trees[size] = _cells(lifted(np.array(vectors, dtype=np.float64), top) @ projection(size, m), leaf)

    def place(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1).to_pylist()
            size = np.array([len(v) for v in vectors], dtype=np.int64)
            cell, at = np.zeros(len(size), dtype=np.int64), [None] * len(size)
            for s in np.unique(size).tolist():
                here = np.flatnonzero(size == s)
                flat = lifted(np.array([vectors[i] for i in here], dtype=np.float64), top) @ projection(s, m)
                cell[here] = _cell_of(trees[s], flat) if s in trees else 0
                for i, f in zip(here.tolist(), flat.tolist()):
                    at[i] = f
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array(size), pa.array(cell), pa.array(at, pa.list_(pa.float64()))],
                ["vec_id", "v", "size", "cell", "at"])

    placed = stored(rows.mapInArrow(place, "vec_id long, v array<double>, size long, cell long, at array<double>"), "cells")
    bounds = [F.min(F.col("at")[j]).alias(f"low{j}") for j in range(m)] + [F.max(F.col("at")[j]).alias(f"high{j}") for j in range(m)]
    # a row a cell: bounded by the sample and the number of lengths
    boxes = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), *bounds).orderBy("size", "cell").collect()
    blocks = {(b["size"], b["cell"]): -(-b["n"] // block) for b in boxes}
    few = F.create_map(*[F.lit(x) for (s, c), j in blocks.items() if j > 1 for x in (f"{s}:{c}", j)]) \
        if max(blocks.values()) > 1 else None
    parts = F.lit(1) if few is None else F.coalesce(
        F.try_element_at(few, F.concat_ws(":", "size", "cell")), F.lit(1))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("long")).select("vec_id", "v", "size", "cell", "part")

    asked = valid(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v")

    def own_block(batches):
        """A query's own cell (that of the vector as a row)."""
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            size = np.array([len(v) for v in vectors], dtype=np.int64)
            cell = np.zeros(len(size), dtype=np.int64)  # as its rows: 0 for lengths that the sample lacks
            for s in np.unique(size).tolist():
                if s in trees:
                    here = np.flatnonzero(size == s)
                    flat = lifted(np.array([vectors[i] for i in here], dtype=np.float64), top) @ projection(s, m)
                    cell[here] = _cell_of(trees[s], flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell)],
                                             ["query_id", "v", "size", "cell"])

    asked = materialize(asked.mapInArrow(own_block, "query_id long, v array<double>, size long, cell long"))
    home = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("long")).withColumn(
        "bound", F.lit(None).cast("double"))
    result = "query_id long, vec_id long, score double"

    def searched(routes: DataFrame) -> DataFrame:
        keys = ["size", "cell", "part"]
        turns = routes.groupBy(*keys).agg(F.ceil(F.count("*") / queries_at_once).cast("int").alias("turns"))
        asked_in = routes.join(turns, keys).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
        # a block meets its queries in turns of bounded size
        again = turns.select(*[F.col(c).alias(c) for c in turns.columns])  # both sides of a cogroup: own columns
        blocks_in = dealt.join(again, keys).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        return blocks_in.groupBy(*keys, "turn").cogroup(asked_in.groupBy(*keys, "turn")).applyInArrow(
            _searcher(k, top, quantile, m), result)

    def best(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = materialize(searched(home))
    kth = best(first).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    sizes: dict[int, list] = {}  # every length, in the sample or not
    for b in boxes:
        sizes.setdefault(b["size"], []).append(b)
    table = {s: (np.array([b["cell"] for b in bs]), np.array([[b[f"low{j}"] for j in range(m)] for b in bs]),
                 np.array([[b[f"high{j}"] for j in range(m)] for b in bs]),
                 [blocks[s, b["cell"]] for b in bs]) for s, bs in sizes.items()}

    def route(batches):
        """The blocks of the cells whose box passes the test, but the query's own."""
        names = ["query_id", "v", "size", "cell", "part", "bound"]
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            for qid, v, size, cell, part, s in zip(*(c.to_pylist() for c in batch.columns)):
                if size not in table:
                    continue
                number, low, high, parts_of = table[size]
                own = np.array(v)
                base = top ** 2 + float(own @ own)
                bound = math.inf if s is None else max(0.0, base - 2 * s)
                at = np.append(own, 0.0) @ projection(size, m)
                gap = np.maximum(np.maximum(low - at, at - high), 0.0)
                near = np.flatnonzero((gap * gap).sum(axis=1) <= quantile * (bound + 1e-9 * base))
                out = [(qid, v, size, c, j, None if s is None else bound) for i in near.tolist()
                       for c in [int(number[i])] for j in range(parts_of[i]) if (c, j) != (cell, part)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    routes = home.drop("bound").join(kth, "query_id", "left").mapInArrow(
        route, "query_id long, v array<double>, size long, cell long, part long, bound double")
    found = first.union(searched(materialize(routes)))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
