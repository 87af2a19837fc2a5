"""Approximate nearest vectors by cosine from a stored index of cells (#38).

* A coarse quantiser (k-means on a bounded sample: ``SAMPLE`` rows of the lowest
  hashes of their keys) divides the unit vectors into cells. Every row is put
  into the cell of its nearest centre.
* What a vector differs by from its centre is stored as a code of ``SUBSPACES``
  bytes: in each subspace the nearest of 256 centres, trained on the residuals
  of the same sample (product quantisation). The codes are laid out by cell on
  disk, the vectors beside them; a search reads the cells that it visits only.
* A search visits the ``probes`` cells nearest to a query first. The k-th score
  found there rules out every cell whose rows would have to stand ``sure``
  standard deviations above what its centre and spread let expect; the others
  are visited too. So the number of visited cells follows from the data: few on
  clustered vectors, most on vectors without any structure.
* Codes are scored by table look-ups; the best ``refine * k`` of a query are
  scored again on the stored vectors, so the returned cosines are exact.

Scale: cells are dealt into parts of about ``BLOCK`` rows, so a cell that holds
a third of all rows is searched by many tasks. Centres and code books are small
tables, bounded by their parameters; only queries and best rows are shuffled.

Vectors that are null, hold null or non-finite components, or are not of the
index's length (the most frequent one of the sample) take no part; the cosine
with a zero vector is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.operators.retrieval import SCORE_DP, small
from corpuskit.session import materialize

SAMPLE = 20_000
CELL_ROWS = 256      # rows a cell, on average, while the number of cells is below MOST_CELLS
MOST_CELLS = 2048
SUBSPACES = 16
CODES = 256
ROUNDS = 12
BLOCK = 16_384


@dataclass(frozen=True)
class VectorCells:
    """``lists``: key, part, code, cell. ``vectors``: key, v, cell. ``centres``: cells x
    dimensions; ``books``: subspaces x codes x dimensions of one; per cell the number
    of parts and the root mean square length of the residuals."""

    lists: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    books: np.ndarray
    parts: np.ndarray
    spread: np.ndarray


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (zero rows stay), without overflow."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre nearest to each row (the first of equal ones)."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i:i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]
                          or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """At most k centres (Lloyd's rounds from rows of the sample); a centre without
    rows moves to the row that lies farthest from its own."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[filled])[:-1]]), axis=0)
        centres[filled] = sums / n[filled, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1), kind="stable")[:len(empty)]
            centres[empty] = x[far]
    return centres


def cuts(d: int, m: int) -> np.ndarray:
    """Ends of the subspaces: m parts of (almost) equal length."""
    return np.linspace(0, d, min(m, d) + 1).round().astype(int)


def encode(rest: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """(rows, subspaces) bytes."""
    at = cuts(rest.shape[1], len(books))
    return np.stack([nearest(rest[:, a:b], book).astype(np.uint8) for a, b, book in zip(at, at[1:], books)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _valid(df: DataFrame, key: str, vec: str) -> DataFrame:
    fine = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(key).isNotNull() & F.col(vec).isNotNull() & fine).select(
        F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("v"))


def write_cells(items: DataFrame, key: str, vec: str, folder: str, cells: int | None = None, sample: int = SAMPLE,
                subspaces: int = SUBSPACES, codes: int = CODES, block: int = BLOCK) -> VectorCells | None:
    """Train on the sample, place every row, and write the index (None if no row takes part)."""
    spark = items.sparkSession
    rows = _valid(items, key, vec)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["n"]
    rows = rows.filter(F.size("v") == d)
    seen = units(np.array([r["v"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(sample).collect()]).reshape(-1, d))
    centres = k_means(seen, cells or int(np.clip(n // CELL_ROWS, 4, MOST_CELLS)))
    rest = seen - centres[nearest(seen, centres)]
    at = cuts(d, subspaces)
    books = [k_means(rest[:, a:b], codes) for a, b in zip(at, at[1:])]

    def place(batches):
        for batch in batches:
            x = units(_matrix(batch.column(1)))
            cell = nearest(x, centres)
            left = x - centres[cell]
            code = encode(left, books)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array([c.tobytes() for c in code], pa.binary()),
                 pa.array((left * left).sum(axis=1)), pa.array(cell, pa.int32())], ["key", "v", "code", "rest", "cell"])

    def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    placed = stored(rows.mapInArrow(place, "key long, v array<double>, code binary, rest double, cell int"), "placed")
    # a row a cell
    found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("rest").alias("rest")).collect()}
    parts = np.array([-(-found[c]["n"] // block) if c in found else 0 for c in range(len(centres))])
    spread = np.sqrt([max(found[c]["rest"], 0.0) if c in found else 0.0 for c in range(len(centres))])
    split = {c: int(p) for c, p in enumerate(parts) if p > 1}
    deal = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for x in split.items() for y in x]), F.col("cell")), F.lit(1)) \
        if split else F.lit(1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key"), deal).cast("int"))
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "part")
    stored(dealt.select("key", "part", "code", "cell").sortWithinPartitions("cell", "part", "key"), "lists", "cell")
    stored(dealt.select("key", F.col("v").cast(dict(items.dtypes)[vec]).alias("v"), "cell").sortWithinPartitions("cell", "key"), "vectors", "cell")
    stored(spark.createDataFrame([(c, [float(y) for y in centres[c]], int(parts[c]), float(spread[c])) for c in range(len(centres))],
                                 "cell int, centre array<double>, parts int, spread double").coalesce(1), "cells")
    stored(spark.createDataFrame([(s, c, [float(y) for y in b]) for s, book in enumerate(books) for c, b in enumerate(book)],
                                 "sub int, code int, centre array<double>").coalesce(1), "books")
    return open_cells(spark, folder)


def open_cells(spark: SparkSession, folder: str) -> VectorCells:
    """An index that ``write_cells`` wrote; its centres and code books are bounded by parameters."""
    table = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    books: dict[int, list] = {}
    for r in spark.read.parquet(f"{folder}/books").orderBy("sub", "code").collect():
        books.setdefault(r["sub"], []).append(np.array(r["centre"]))
    return VectorCells(
        spark.read.schema("key long, part int, code binary, cell int").parquet(f"{folder}/lists"),
        spark.read.parquet(f"{folder}/vectors"),
        np.array([r["centre"] for r in table]), [np.array(books[s]) for s in sorted(books)],
        np.array([r["parts"] for r in table]), np.array([r["spread"] for r in table]))


def _scanner(index: VectorCells, most: int):
    """Cogroup function: the codes of a part and the queries that visit it."""
    centres, books = index.centres, index.books
    at = cuts(centres.shape[1], len(books))
    schema = pa.schema([("qid", pa.int64()), ("key", pa.int64()), ("cell", pa.int32()), ("approx", pa.float64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and asked.num_rows:
            code = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
            keys, cell = rows["key"].to_numpy(), rows["cell"][0].as_py()
            for qid, q in zip(asked["qid"].to_pylist(), _matrix(asked["v"].combine_chunks())):
                score = np.full(len(keys), float(q @ centres[cell]))
                for j, (a, b) in enumerate(zip(at, at[1:])):
                    score += (books[j] @ q[a:b])[code[:, j]]
                best = np.arange(len(keys)) if len(keys) <= most else np.flatnonzero(
                    score >= np.partition(score, len(keys) - most)[len(keys) - most])
                best = best[np.lexsort((keys[best], -score[best]))][:most]
                for x, y in zip(out, (np.full(len(best), qid), keys[best], np.full(len(best), cell), score[best])):
                    x.append(y)
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0), f.type) for x, f in zip(out, schema)],
                                    schema=schema)

    return run


def phases(index: VectorCells, asked: DataFrame, k: int, most: int, probes: int, sure: float) -> tuple[DataFrame, DataFrame, list[int]]:
    """(found, visits, cells) of a search for ``asked`` (qid, v): the best ``most`` rows of
    every visited part by code (qid, key, cell, approx), the visits (qid, cell, part),
    and the cells that any query visits."""
    centres, parts, spread = index.centres, index.parts, index.spread
    d = centres.shape[1]
    filled = np.flatnonzero(parts)

    def routed(visits):
        """Rows (qid, unit vector, cell, part) of the cells that ``visits(unit vectors, batch)`` names."""
        def run(batches):
            for batch in batches:
                x = units(_matrix(batch.column(1)))
                rows, cell, part = [], [], []
                for i, own in enumerate(visits(x, batch)):
                    for c in own:
                        for p in range(parts[c]):
                            rows.append(i)
                            cell.append(int(c))
                            part.append(p)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(list(x), pa.list_(pa.float64())).take(take),
                     pa.array(cell, pa.int32()), pa.array(part, pa.int32())], ["qid", "v", "cell", "part"])
        return run

    def first_cells(x: np.ndarray) -> np.ndarray:
        return filled[np.argsort(-(x @ centres[filled].T), axis=1, kind="stable")[:, :probes]]

    def other_cells(x: np.ndarray, batch) -> list[np.ndarray]:
        kth = batch.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)
        reach = x @ centres[filled].T + sure * spread[filled] / np.sqrt(d)
        return [np.setdiff1d(filled[r >= t], own) for r, t, own in zip(reach, kth, first_cells(x))]

    schema = "qid long, v array<double>, cell int, part int"

    def visited(routes: DataFrame) -> tuple[DataFrame, list[int]]:
        # the cells of a batch are a partition filter of the scan: at most MOST_CELLS numbers
        numbers = sorted(r["cell"] for r in routes.select("cell").distinct().collect())
        lists = index.lists.filter(F.col("cell").isin(numbers))
        return lists.groupBy("cell", "part").cogroup(routes.groupBy("cell", "part")).applyInArrow(
            _scanner(index, most), "qid long, key long, cell int, approx double"), numbers

    routes = materialize(asked.mapInArrow(routed(lambda x, _: first_cells(x)), schema))
    found, numbers = visited(routes)
    found = materialize(found)
    kth = _best(found, k).filter(F.col("_r") == k).select("qid", F.col("approx").alias("kth"))
    further = materialize(asked.join(kth, "qid", "left").select("qid", "v", "kth").mapInArrow(routed(other_cells), schema))
    more, others = visited(further)
    visits = routes.unionByName(further).select("qid", "cell", "part")
    return found.unionByName(more), visits, sorted({*numbers, *others})


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("approx"), "key")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)


def search(index: VectorCells, queries: DataFrame, qid: str, qvec: str, key: str, k: int = 5, probes: int = 4,
           refine: int = 10, sure: float = 3.0) -> DataFrame:
    """(qid, rank, key, score): about the k nearest of every query, with their exact cosines."""
    asked = materialize(_valid(queries, qid, qvec).filter(F.size("v") == index.centres.shape[1])
                        .select(F.col("key").alias("qid"), "v"))
    found, _, cells = phases(index, asked, k, refine * k, probes, sure)
    chosen = small(materialize(_best(found, refine * k).select("qid", "key", "cell")))
    stored = index.vectors.filter(F.col("cell").isin(cells))
    # exact cosines of the chosen rows
    met = stored.join(chosen, ["cell", "key"]).join(small(asked.withColumnRenamed("v", "q")), "qid")
    exact = met.select("qid", "key", _cosine(F.col("v").cast("array<double>"), F.col("q")).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", SCORE_DP).desc(), "key")
    return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("qid").alias(qid), "rank", F.col("key").alias(key), "score")


def _cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors (0 with a zero vector), without overflow."""
    def scaled(x: Column) -> Column:
        most = F.greatest(F.array_max(F.transform(x, lambda y: F.abs(y))), F.lit(1e-300))
        return F.transform(x, lambda y: y / most)

    def norm(x: Column) -> Column:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))

    a, b = scaled(a), scaled(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
