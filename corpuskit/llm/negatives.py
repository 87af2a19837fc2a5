"""Hard-negative mining by segment summaries.

A vector is cut into segments; each segment is stored as its mean and its
deviation. In a segment the inner product of two vectors is that of their means
plus that of their residuals, and the latter is at most the product of their
deviations. Summed over the segments, means' products plus or minus deviations'
products bound the score from both sides. Segments are refined level by level
(a few long ones, then ``LENGTH`` components each); only rows whose bounds still
reach the wanted scores go on, and the last of them are scored exactly.

* Positives: an anchor meets the rows of its label alone. Labels are hashed into
  buckets and a bucket is dealt into blocks by a hash of the id, so a label that
  holds a third of all rows is spread, and very many small labels share blocks.
* Negatives: rows are put into cells by their coarse summaries (splits fitted on
  a bounded sample, every row placed), cells are dealt into blocks. A cell keeps
  the box of its summaries; an anchor goes only to cells whose box can hold a
  score between its least and largest wanted one.
* In a block, ``ANCHORS`` anchors at a time take the rows in runs; what is found
  raises the wanted scores for the runs after it. Each block returns its best
  rows only, and a top-k window (limited per task) merges the blocks.

Scores are integers: components become ``floor(scale * x)`` and products are
exact, in double precision where that holds them, else as integers. A score
beyond the range of long counts as its nearest end.

Defined results: rows with a null id, label or vector, or a component that is
null or not finite (also after scaling), take no part; only vectors of equal
length meet (empty ones score 0); rows that repeat an anchor's id are never its
partners, other repeated rows count one by one; an id is an anchor once, with
its smallest label and vector; an empty table gives an empty result; extra
columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import materialize, stored
from corpuskit.llm.neighbours import _cell_of, _cells

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
LENGTH, MERGED = 4, 4  # components of the finest segments; segments that make one of the next level
BLOCK, ANCHORS = 8192, 1024
SAMPLE = 20_000  # rows that the splits of the cells are fitted on
_LONG = np.iinfo(np.int64)
_SLACK = 1e-6  # of a vector's norm, on every deviation: far above rounding


# ------------------------------------------------------- summaries and bounds

def summary(z: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, lengths) of the segments of each row, both times the
    root of the segment's length, so that products of rows need no weights."""
    at = np.arange(0, max(z.shape[1], 1), length)
    sizes = np.diff(np.append(at, max(z.shape[1], 1)))
    if not z.shape[1]:
        return np.zeros((len(z), 1)), np.zeros((len(z), 1)), sizes
    mean = np.add.reduceat(z, at, axis=1) / np.sqrt(sizes)
    centred = z - np.repeat(mean / np.sqrt(sizes), sizes, axis=1)
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return mean, np.sqrt(np.add.reduceat(centred * centred, at, axis=1)) + _SLACK * norm, sizes


def coarser(mean: np.ndarray, dev: np.ndarray, sizes: np.ndarray, merged: int = MERGED):
    """The summaries of segments that join ``merged`` neighbours each."""
    at = np.arange(0, len(sizes), merged)
    total = np.add.reduceat(sizes, at)
    up = np.add.reduceat(mean * np.sqrt(sizes), at, axis=1) / np.sqrt(total)
    # residuals: those inside the parts, and those of the parts' means
    back = mean - np.repeat(up / np.sqrt(total), np.diff(np.append(at, len(sizes))), axis=1) * np.sqrt(sizes)
    return up, np.sqrt(np.add.reduceat(back * back + dev * dev, at, axis=1)), total


def levels(mean: np.ndarray, dev: np.ndarray, sizes: np.ndarray, merged: int = MERGED) -> list[tuple]:
    """(means, deviations) from the coarsest level, of at most ``merged`` segments, to the finest."""
    out = [(mean, dev)]
    while len(sizes) > merged:
        mean, dev, sizes = coarser(mean, dev, sizes, merged)
        out.append((mean, dev))
    return out[::-1]


def bounds(anchor: tuple, rows: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of anchors and rows at one level."""
    middle, width = anchor[0] @ rows[0].T, anchor[1] @ rows[1].T
    return middle - width, middle + width


def scores(q: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact integer inner products (integer-valued doubles in; long range out)."""
    def clipped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        whole = [np.array([[int(x) for x in row] for row in part], dtype=object).reshape(part.shape) for part in (a, b)]
        exact = (whole[0] @ whole[1].T) if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
        return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)

    if not q.size or not z.size:
        return np.zeros((len(q), len(z)))
    most = (2.0 ** 53 / q.shape[1]) ** 0.5
    easy_q, easy_z = np.abs(q).max(axis=1) < most, np.abs(z).max(axis=1) < most
    if easy_q.all() and easy_z.all():
        return q @ z.T
    out = np.zeros((len(q), len(z)), dtype=np.int64)
    for mine, a in ((easy_q, True), (~easy_q, False)):
        for other, b in ((easy_z, True), (~easy_z, False)):
            if mine.any() and other.any():
                out[np.ix_(mine, other)] = (q[mine] @ z[other].T) if a and b else clipped(q[mine], z[other])
    return out


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of negatives of a positive with this score."""
    whole, rest = positive // 100, positive % 100  # no product leaves the range of long
    return LOW * whole - (-LOW * rest) // 100, HIGH * whole + HIGH * rest // 100


def search(anchors: dict, rows: dict, k: int, same: bool, run: int = 4096):
    """The first k rows of each anchor and window: (anchor, window, id, score) arrays.

    ``anchors``: z, levels, label, id, low and high (anchors x windows);
    ``rows``: z, levels, label, id. ``same``: rows of the anchor's label, else
    of other labels. Scores descend, ties go to the smaller id.
    """
    n, wide = anchors["low"].shape
    low, high = anchors["low"], anchors["high"]
    kth = np.full(n * wide, _LONG.min)  # the k-th score of a window so far
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # window, id, score
    most = high.max(axis=1)
    at, total = 0, len(rows["id"])
    while at < total:
        here = np.arange(at, min(total, at + (256 if not at else run)))
        at = here[-1] + 1
        wanted = np.maximum(low, kth.reshape(n, wide))
        least = wanted.min(axis=1)
        for a, r in zip(anchors["levels"], rows["levels"]):
            lower, upper = bounds(a, (r[0][here], r[1][here]))
            out = (upper < least[:, None]) | (lower > most[:, None])
            here = here[~out.all(axis=0)]
        if not len(here):
            continue
        s = scores(anchors["z"], rows["z"][here])
        fits = anchors["label"][:, None] == rows["label"][here][None, :]
        fits = (fits if same else ~fits) & (anchors["id"][:, None] != rows["id"][here][None, :])
        a, c = np.nonzero(fits & (s >= least[:, None]) & (s <= most[:, None]))
        found, names = s[a, c].astype(np.int64), rows["id"][here][c]
        for j in range(wide):
            ok = (found >= wanted[a, j]) & (found <= high[a, j])
            best = [np.concatenate([x, y]) for x, y in zip(best, (a[ok] * wide + j, names[ok], found[ok]))]
        order = np.lexsort((best[1], ~best[2], best[0]))
        best = [x[order] for x in best]
        rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [x[rank < k] for x in best]
        full = rank[rank < k] == k - 1
        kth[best[0][full]] = best[2][full]
    return best[0] // wide, best[0] % wide, best[1], best[2]


# ------------------------------------------------------------------ the job

def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _side(table: pa.Table, size: int) -> dict:
    parts = max(-(-size // LENGTH), 1)
    sizes = np.diff(np.append(np.arange(0, max(size, 1), LENGTH), max(size, 1)))
    return {"z": _matrix(table["z"], size), "label": table["label"].to_numpy(), "id": table["vec_id"].to_numpy(),
            "levels": levels(_matrix(table["mean"], parts), _matrix(table["dev"], parts), sizes)}


def _searcher(k: int, same: bool):
    """Cogroup function: a block's rows and a part of its anchors. An anchor's
    windows are its positives' (none: one window without ends)."""
    schema = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64)] * 4
        if rows.num_rows and asked.num_rows:
            size = asked["size"][0].as_py()
            anchors = _side(asked, size)
            if same:
                low, high = np.full((asked.num_rows, 1), _LONG.min), np.full((asked.num_rows, 1), _LONG.max)
            else:  # fewer positives: windows that nothing fits
                given = asked["scores"].to_pylist()
                wide = max(map(len, given))
                low, high = np.full((len(given), wide), _LONG.max), np.full((len(given), wide), _LONG.min)
                for i, x in enumerate(given):
                    low[i, :len(x)], high[i, :len(x)] = windows(np.array(x, dtype=np.int64))
            a, j, found, s = search(anchors | {"low": low, "high": high}, _side(rows, size), k, same)
            cols = [anchors["id"][a], j, found, s]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return run


def _meet(blocks: DataFrame, asked: DataFrame, keys: list[str], k: int, same: bool) -> DataFrame:
    """Every block with the anchors that are routed to it, ``ANCHORS`` at a time."""
    turns = asked.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("turns"))
    left = asked.join(turns, keys).withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int"))
    again = turns.select(*[F.col(c).alias(c) for c in turns.columns])  # both sides of a cogroup: own columns
    right = blocks.join(again, keys).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    return right.groupBy(*keys, "turn").cogroup(left.groupBy(*keys, "turn")).applyInArrow(
        _searcher(k, same), "anchor_id long, window int, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _valid(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    def finite(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf")))

    v = F.col(vec_col)
    return df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, finite)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: x.cast("double") * float(scale)).alias("v"), F.size(v).alias("size"))


def mine(items: DataFrame, anchors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK,
         sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For every anchor and each of its first ``positives`` rows of the same label,
    the first ``negatives`` rows of other labels that score between ``LOW`` and
    ``HIGH`` percent of the positive's score.
    """
    spark = items.sparkSession
    rows = _valid(items, id_col, label_col, vec_col, scale)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")

    # splits of the cells: on the coarsest summaries of a bounded sample (lowest hashes of the ids)
    seen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        seen.setdefault(r["size"], []).append(r["v"])

    def point(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mean, dev, sizes = summary(z)
        return mean, dev, *levels(mean, dev, sizes)[0]

    leaf = max(8, sample * block // max(n, sample) // 2)
    trees = {s: _cells(point(np.floor(np.array(v, dtype=np.float64).reshape(len(v), s)))[2], leaf) for s, v in seen.items()}
    lists = pa.list_(pa.float64())

    def place(batches):
        """Integer components, finest and coarsest summaries, and the cell of every row."""
        for batch in batches:
            size = batch.column(2).to_numpy()
            for s in np.unique(size).tolist():
                own = batch.filter(pa.array(size == s))
                z = np.floor(_matrix(own.column(3), s))
                mean, dev, top, spread = point(z)
                cell = _cell_of(trees[s], top) if s in trees else np.zeros(len(z), dtype=np.int64)
                arrays = [pa.array(list(x), lists) for x in (z, mean, dev, top, spread)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), *arrays, pa.array(cell)], names)

    names = ["vec_id", "label", "size", "z", "mean", "dev", "top", "spread", "cell"]
    schema = ("vec_id long, label long, size int, z array<double>, mean array<double>, dev array<double>, "
              "top array<double>, spread array<double>, cell long")
    cols = ["vec_id", "label", "size", "v"]
    placed = stored(rows.select(*cols).mapInArrow(place, schema), "summaries")
    chosen = _valid(anchors, id_col, label_col, vec_col, scale).groupBy("vec_id").agg(
        F.min(F.struct("label", "size", "v")).alias("a")).select("vec_id", "a.label", "a.size", "a.v")
    asked = materialize(chosen.select(*cols).mapInArrow(place, schema).drop("cell"))

    # positives: blocks of the buckets of labels
    buckets = max(1, -(-n // block))
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets)).alias("bucket")
    parts = materialize(placed.groupBy("size", bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    labelled = placed.select("*", bucket).join(parts, ["size", "bucket"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
    routed = asked.select("*", bucket).join(parts, ["size", "bucket"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = ["vec_id", "label", "size", "z", "mean", "dev"]
    keys = ["size", "bucket", "part"]
    near = _first(_meet(labelled.select(*kept, "bucket", "part"), routed.select(*kept, "bucket", "part"), keys, positives, True),
                  positives)
    # at most ``positives`` of an anchor
    own = materialize(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own")))

    # negatives: the cells whose box can hold a wanted score
    box = [f(F.try_element_at(c, F.lit(i + 1))).alias(f"{name}{i}") for i in range(MERGED)
           for name, f, c in (("low", F.min, F.col("top")), ("high", F.max, F.col("top")), ("most", F.max, F.col("spread")))]
    # a row a cell: bounded by the sample and the number of lengths
    cells: dict[int, list] = {}
    for b in placed.groupBy("size", "cell").agg(F.count("*").alias("n"), *box).orderBy("size", "cell").collect():
        cells.setdefault(b["size"], []).append(b)
    boxes = {}
    for s, own_cells in cells.items():
        dims = [i for i in range(MERGED) if own_cells[0][f"low{i}"] is not None]
        boxes[s] = (*(np.array([[b[f"{name}{i}"] for i in dims] for b in own_cells]) for name in ("low", "high", "most")),
                    [b["cell"] for b in own_cells], [-(-b["n"] // block) for b in own_cells])
    many = {(s, c): p for s, b in boxes.items() for c, p in zip(b[3], b[4]) if p > 1}
    n_parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for (s, c), p in many.items() for x in (f"{s}:{c}", p)]),
                                          F.concat_ws(":", "size", "cell")), F.lit(1)) if many else F.lit(1)
    dealt = placed.select(*kept, "cell", F.pmod(F.xxhash64("vec_id", F.lit(2)), n_parts).cast("int").alias("part"))

    def route(batches):
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            size, given = at["size"].to_numpy(), at["scores"].to_pylist()
            take, cell, part = [], [], []
            for i, (s, x) in enumerate(zip(size.tolist(), given)):
                least, largest, most_dev, number, split = boxes[s]
                q, d = np.array(at["top"][i].as_py()), np.array(at["spread"][i].as_py())
                ends = q * least, q * largest
                width = most_dev @ d
                want = windows(np.array(x, dtype=np.int64))
                fits = ~(np.maximum(*ends).sum(axis=1) + width < want[0].min()) & ~(
                    np.minimum(*ends).sum(axis=1) - width > want[1].max())
                for c in np.flatnonzero(fits).tolist():
                    for p in range(split[c]):
                        take.append(i)
                        cell.append(number[c])
                        part.append(p)
            chosen_rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [at[c].take(chosen_rows) for c in (*kept, "scores")] + [pa.array(cell, pa.int64()), pa.array(part, pa.int32())],
                [*kept, "scores", "cell", "part"])

    wanted = asked.join(own.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn(
        "scores", F.transform("own", lambda x: x["score"]))
    routes = materialize(wanted.select(*kept, "top", "spread", "scores").mapInArrow(
        route, "vec_id long, label long, size int, z array<double>, mean array<double>, dev array<double>, "
               "scores array<long>, cell long, part int"))
    hard = _first(_meet(dealt, routes, ["size", "cell", "part"], negatives, False), negatives)
    pair = F.element_at("own", F.col("window") + 1)
    return hard.join(own, "anchor_id").select(
        "anchor_id", pair["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), pair["score"].alias("positive_score"), F.col("score").alias("negative_score"))


#: The registered query in DuckDB SQL, every pair scored.
ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(coalesce(list_dot_product(a.z, b.z), 0) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.z) = len(b.z) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
