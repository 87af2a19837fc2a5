"""Keyword, vector and hybrid retrieval for whole tables of queries.

Scale notes
-----------
* BM25 joins the query terms, weighted, with an index partitioned by term
  (``operators.index``): the scan reads the parts of the batch's terms only.
  ``bm25_topk`` skips ranges of chunks by their bounds; where every match counts
  (``bm25_search``) one ``groupBy(query, chunk)`` sums the weights. N and avgdl
  are scalar subqueries.
* Exact vector top-k never materialises query x item pairs as rows: queries
  and items are hashed into bounded blocks, each (query block, item block)
  group runs one numpy matrix product and emits only its top-k per query plus
  the per-query min/max needed by score fusion.
* Per-query top-k uses ``row_number() <= k``; Spark plans it as a partial
  ``WindowGroupLimit`` before the shuffle, so a hot query sends at most k rows
  per map task.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions.text import tokens
from corpuskit.session import materialize

# --- fixed values ------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
DEFAULT_TOP_K = 5
MIN_TOP_K = 1
MAX_TOP_K = 25
DEFAULT_THRESHOLD = 0.3
DEFAULT_RESPONSE_MODE = "synthesis"
# response mode aliases, in the order of the original table
MODE_ALIASES = {"smart": "synthesis", "synthesis": "synthesis", "raw": "raw", "both": "both"}
# filename-shaped queries are pure keyword lookups
FILENAME_QUERY = r"(?i)^[\p{L}\p{N}_.\-]+\.(pdf|docx|txt|xlsx|csv)$"
WS = r"[ \t\n\x0B\f\r]"    # Python's str.split() whitespace (ASCII)
SCORE_DP = 6               # ranking compares scores rounded to this many places
# -----------------------------------------------------------------------------


def _round_rank(c: Column) -> Column:
    return F.round(c, SCORE_DP)


# ---------------------------------------------------------------- BM25 (#36)

def postings(chunks: DataFrame, keys: list[str], text_col: str = "content",
             stop_words: list[str] | None = None) -> DataFrame:
    """Inverted postings ``keys..., dl, term, tf, first``.

    ``first`` is true on exactly one row per chunk (a chunk without tokens
    keeps one row with a null term), which lets N and avgdl be computed from
    this table alone.
    """
    # Hash-partition the chunk rows by their key first: every token of a
    # chunk is then already in the partition its (chunk, term) group needs,
    # so the aggregate runs without shuffling one row per token; keying on
    # the chunk (not the document) keeps a giant document spread out.
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    toks = chunks.repartition(parts, *keys).select(*keys, tokens(text_col, stop_words).alias("_t"))
    exploded = toks.select(*keys, F.size("_t").alias("dl"),
                           F.posexplode_outer("_t").alias("_pos", "term"))
    return (exploded.groupBy(*keys, "dl", "term")
            .agg(F.count(F.lit(1)).alias("tf"), F.min("_pos").alias("_minpos"))
            .withColumn("first", F.coalesce(F.col("_minpos") == 0, F.lit(True)))
            .drop("_minpos"))


def query_terms(queries: DataFrame, qid: str = "query_id", qtext: str = "query",
                stop_words: list[str] | None = None) -> DataFrame:
    """Distinct (query, term) pairs."""
    return queries.select(qid, F.explode(F.array_distinct(tokens(qtext, stop_words))).alias("term"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, keys: list[str],
                text_col: str = "content", qid: str = "query_id", qtext: str = "query",
                k1: float = BM25_K1, b: float = BM25_B,
                stop_words: list[str] | None = None) -> DataFrame:
    """BM25 score of every chunk sharing a term with a query: ``qid, keys..., bm25``.

    For chunk rows without a stored index: the postings are read by four
    branches (N, avgdl, df, scoring), so they are checkpointed once.
    """
    p = materialize(postings(chunks, keys, text_col, stop_words))
    firsts = p.filter("first")
    terms = p.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _bm25(p, terms, firsts.select(F.count(F.lit(1))).scalar(), firsts.select(F.avg("dl")).scalar(),
                 query_terms(queries, qid, qtext, stop_words), qid, keys, k1, b)


def _bm25(p: DataFrame, terms: DataFrame, n_docs: Column, avgdl: Column, qt: DataFrame, qid: str, keys: list[str],
          k1: float, b: float, on: list[str] | None = None) -> DataFrame:
    """idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N, avgdl and df over all chunks.
    The postings meet only the query terms, weighted before the join."""
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = qt.join(terms, "term").select(*qt.columns, idf.alias("idf"))
    tfn = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return (p.filter(F.col("term").isNotNull()).join(weighted, on or ["term"])
            .groupBy(qid, *keys).agg(F.sum(F.col("idf") * tfn).alias("bm25")))


#: Distinct terms of a batch of queries up to which they are compiled into the scan's filter.
MOST_TERMS = 1000
#: Ranges of a query that the first phase of ``bm25_topk`` scores whole.
FIRST_RANGES = 8
#: Terms of a query up to which ``bm25_topk`` bounds ranges first: the maxima of
#: many terms add up to bounds that hardly any range falls short of.
SHORT_QUERY = 6


def _tfn(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """Weight of a posting: grows with ``tf``, falls with ``dl``."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _weighted(index, qt: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """(blocks of the terms of ``qt``, ``qt`` with part and idf, avgdl).

    The parts that hold the batch's terms are a partition filter of the scan:
    a list of at most ``index.parts`` numbers, from a job over the queries
    alone. A batch of few terms filters on the terms as well.
    """
    from corpuskit.operators.index import part_of

    parted = qt.withColumn("part", part_of(F.col("term"), index.parts))
    found = parted.select("part", "term").distinct().limit(MOST_TERMS + 1).collect()
    held = F.col("term").isNotNull()
    if len(found) <= MOST_TERMS:
        held = F.col("part").isin([r["part"] for r in found]) & F.col("term").isin([r["term"] for r in found])
    else:
        numbers = [r["part"] for r in parted.select("part").distinct().collect()]
        held = held & F.col("part").isin(numbers)
    n_docs, avgdl = index.stats.select("n_docs").scalar(), index.stats.select("avgdl").scalar()
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = parted.join(index.terms.filter(held), ["part", "term"]).select(*parted.columns, idf.alias("idf"))
    return index.blocks.filter(held), weighted, avgdl


def _scored(blocks: DataFrame, weighted: DataFrame, avgdl: Column, qid: str, keys: list[str], on: list[str],
            k1: float, b: float, wanted: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """BM25 of the postings of the blocks that meet ``weighted`` on part, term and
    ``on``, in the given (query, range) and of the ``wanted`` (query, chunk) only."""
    met = blocks.join(weighted, ["part", "term", *on])
    if ranges is not None:
        met = met.join(ranges, [qid, "range"], "left_semi")
    rows = met.select(qid, "idf", F.inline("entries"))
    if wanted is not None:
        rows = rows.join(wanted, [qid, *keys], "left_semi")
    return rows.groupBy(qid, *keys).agg(F.sum(F.col("idf") * _tfn(F.col("tf"), F.col("dl"), avgdl, k1, b)).alias("bm25"))


def bm25_search(index, queries: DataFrame, keys: list[str], qid: str = "query_id", qtext: str = "query",
                wanted_file: str | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 over a stored index (``operators.index.SearchIndex``): ``qid, keys..., bm25`` of every match.

    ``wanted_file`` (#10): a column of ``queries``; a query that names a file
    meets only the blocks of that file's ranges, and only that file's chunks
    are scored; N, avgdl and df stay those of the whole collection.
    """
    blocks, weighted, avgdl = _weighted(index, query_terms(queries, qid, qtext))
    weighted = small(materialize(weighted))  # a join with a small table leaves the blocks where they are
    if wanted_file is None:
        return _scored(blocks, weighted, avgdl, qid, keys, [], k1, b)
    named = queries.select(qid, F.col(wanted_file).alias("source_filename"))
    free = weighted.join(named.filter(F.col("source_filename").isNull()).select(qid), qid, "left_semi")
    chosen = materialize(named.join(index.chunks.select("source_filename", *keys, "range"), "source_filename"))
    bound = small(materialize(weighted.join(chosen.select(qid, "range").distinct(), qid)))
    return _scored(blocks, small(materialize(free)), avgdl, qid, keys, [], k1, b).unionByName(
        _scored(blocks, bound, avgdl, qid, keys, ["range"], k1, b, wanted=small(chosen.select(qid, *keys))))


#: Chunks, whole ranges of them, that one task scores together, and queries at a time.
GROUP_CHUNKS = 4096
GROUP_QUERIES = 1024
#: Chunks of each group that a scan for a ranked list keeps, in times of its depth.
WIDER = 4


def _group_scorer(qid: str, keys: list[str], k: int | None, k1: float, b: float):
    """Function of the blocks of a group of ranges, each with the queries of its term:
    (qid, keys, bm25, low, high, cut), for each query its k best chunks (or, without
    k, those that reach its floor), its least and largest score in the group, and
    the score down to which its chunks of the group are all among them."""
    schema = pa.schema([(qid, pa.int64()), *[(c, pa.int64()) for c in keys],
                        *[(c, pa.float64()) for c in ("bm25", "low", "high", "cut")]])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()

        def flat(name: str) -> np.ndarray:
            return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)

        columns = [flat(f"_{c}").astype(np.int64) for c in keys]
        n = len(columns[0])
        code = np.zeros(n, dtype=np.int64)
        for c in columns:  # chunks are numbered within the group, in the order of their keys
            values, own = np.unique(c, return_inverse=True)
            code = np.unique(code * len(values) + own, return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1]
        avgdl = table["_avgdl"][0].as_py()
        dl, tf = flat("_dl").astype(np.float64), flat("_tf").astype(np.float64)
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        names, queries = np.unique(flat("_q"), return_inverse=True)
        idf = flat("_idf")
        total = np.zeros((len(names), len(first)))  # a posting's weight is above zero, so a zero tells no match
        size = table["_n"].to_numpy()
        start = np.concatenate([[0], np.cumsum(size)])
        asked = np.concatenate([[0], np.cumsum(pc.list_value_length(table["_q"].combine_chunks()).to_numpy())])
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(term, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(term[order])) + 1):  # the blocks of a term
            at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
            own = slice(asked[rows[0]], asked[rows[0] + 1])
            total[np.ix_(queries[own], code[at])] += idf[own][:, None] * weight[at][None, :]
        met = total > 0
        low = np.where(met, total, np.inf).min(axis=1)
        total[~met] = -np.inf
        high = total.max(axis=1)
        ranked = np.round(total, SCORE_DP)
        if k is None:
            floor = np.full(len(names), np.inf)
            floor[queries] = flat("_floor")
            chosen = total >= floor[:, None]
        elif k < len(first):
            chosen = ranked >= np.partition(ranked, len(first) - k, axis=1)[:, len(first) - k][:, None]
        else:
            chosen = met
        query, chunk = np.nonzero(chosen & met)
        if k is not None:  # of equal scores the smaller keys
            order = np.lexsort((chunk, -ranked[query, chunk], query))
            chunk, query = chunk[order], query[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            chunk, query = chunk[rank < k], query[rank < k]
        # below the last score of a query that has more chunks here than were taken, not all are known
        taken, least = np.bincount(query, minlength=len(names)), np.full(len(names), np.inf)
        np.minimum.at(least, query, total[query, chunk])
        cut = np.where(taken < met.sum(axis=1), least, -np.inf)
        out = [names[query], *[c[first][chunk] for c in columns], total[query, chunk], low[query], high[query], cut[query]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    return run


def _grouped(index, blocks: DataFrame, weighted: DataFrame, avgdl: Column, n_queries: int, qid: str, keys: list[str],
             k1: float, b: float, k: int | None = None, floors: DataFrame | None = None) -> DataFrame:
    """Scores by groups of ranges: a block crosses the network once for all queries of its
    term (and per ``GROUP_QUERIES`` queries), a (query, chunk) pair never does."""
    turns = F.lit(max(1, -(-n_queries // GROUP_QUERIES)))
    asked = weighted.withColumn("_turn", F.pmod(F.xxhash64(qid), turns))
    if floors is not None:
        asked = asked.join(floors.select(qid, F.col("floor").alias("_floor")), qid)
    extra = ["_floor"] if floors is not None else []
    from corpuskit.operators.index import ENTRY

    lists = asked.groupBy("part", "term", "_turn").agg(F.collect_list(F.struct(F.col(qid).alias("_q"), F.col("idf").alias("_idf"), *extra))
                                                       .alias("_l"))
    groups = max(1, -(-index.ranges // max(1, GROUP_CHUNKS // index.width)))
    rows = blocks.join(small(materialize(lists)), ["part", "term"]).select(
        F.pmod("range", F.lit(groups)).alias("_g"), "_turn", "term", F.col("n").alias("_n"),
        *[F.col(f"{ENTRY}{c}").alias(f"_{c}") for c in (*keys, "dl", "tf")], avgdl.alias("_avgdl"),
        *[F.col(f"_l.{c}").alias(c) for c in ("_q", "_idf", *extra)])
    schema = f"{qid} long, " + ", ".join(f"{c} long" for c in keys) + ", bm25 double, low double, high double, cut double"
    return rows.groupBy("_g", "_turn").applyInArrow(_group_scorer(qid, keys, k, k1, b), schema)


class IndexScores:
    """BM25 scores of a table of queries over a stored index, asked for in parts.

    Nothing of the size of queries x chunks is written or shuffled. Keys are integers.
    """

    def __init__(self, index, queries: DataFrame, keys: list[str], qid: str = "query_id", qtext: str = "query",
                 k1: float = BM25_K1, b: float = BM25_B):
        self.index, self.keys, self.qid, self.how = index, keys, qid, (k1, b)
        self.queries = queries.count()
        self.blocks, weighted, self.avgdl = _weighted(index, query_terms(queries, qid, qtext))
        self.weighted = materialize(weighted)

    def _scan(self, weighted: DataFrame, queries: int, **how) -> DataFrame:
        return materialize(_grouped(self.index, self.blocks, weighted, self.avgdl, queries, self.qid, self.keys, *self.how, **how))

    def best(self, depth: int) -> tuple[DataFrame, DataFrame]:
        """(qid, keys, bm25) of each query's ``depth`` best chunks; (qid, bmin, bmax)."""
        self.found = self._scan(self.weighted, self.queries, k=WIDER * depth)
        ends = self.found.groupBy(self.qid).agg(F.min("low").alias("bmin"), F.max("high").alias("bmax"))
        best = top_k(self.found, self.qid, "bm25", self.keys, depth, rank_col="_r")
        return best.select(self.qid, *self.keys, "bm25"), ends

    def of(self, pairs: DataFrame) -> DataFrame:
        """(qid, keys, bm25) of those pairs that share a term, from the texts of their chunks: no block is read."""
        at = self.index.chunks.select(*self.keys).join(small(materialize(pairs.select(self.qid, *self.keys))), self.keys)
        at = small(materialize(at))
        texts = self.index.chunks.join(small(materialize(at.select(*self.keys).distinct())), self.keys, "left_semi")
        rows = postings(texts.select(*self.keys, F.monotonically_increasing_id().alias("_at"), "content"), [*self.keys, "_at"])
        rows = rows.filter(F.col("term").isNotNull()).join(at, self.keys).join(small(self.weighted), [self.qid, "term"])
        weight = F.col("idf") * _tfn(F.col("tf"), F.col("dl"), self.avgdl, *self.how)
        return rows.groupBy(self.qid, *self.keys).agg(F.sum(weight).alias("bm25"))

    def above(self, floors: DataFrame) -> DataFrame:
        """(qid, keys, bm25) of the chunks that reach their query's ``floor``: from what ``best``
        has seen, and by another scan for queries whose floor lies below that."""
        cuts = self.found.groupBy(self.qid).agg(F.max("cut").alias("cut"))
        floors = small(materialize(floors.join(cuts, self.qid)))
        seen = self.found.join(floors.filter("floor > cut").select(self.qid, "floor"), self.qid).filter("bm25 >= floor")
        seen = seen.select(self.qid, *self.keys, "bm25")
        deep = floors.filter("floor <= cut")
        n = deep.count()
        if not n:
            return seen
        more = self._scan(self.weighted.join(deep.select(self.qid), self.qid, "left_semi"), n, floors=deep)
        return seen.unionByName(more.select(self.qid, *self.keys, "bm25"))


class TableScores:
    """The same for scores that stand in a table (qid, keys..., bm25)."""

    def __init__(self, bm25: DataFrame, keys: list[str], qid: str = "query_id"):
        self.bm25, self.keys, self.qid = bm25, keys, qid

    def best(self, depth: int) -> tuple[DataFrame, DataFrame]:
        ends = self.bm25.groupBy(self.qid).agg(F.min("bm25").alias("bmin"), F.max("bm25").alias("bmax"))
        best = top_k(self.bm25, self.qid, "bm25", self.keys, depth, rank_col="_r")
        return best.select(self.qid, *self.keys, "bm25"), ends

    def of(self, pairs: DataFrame) -> DataFrame:
        return self.bm25.join(small(materialize(pairs.select(self.qid, *self.keys))), [self.qid, *self.keys])

    def above(self, floors: DataFrame) -> DataFrame:
        return self.bm25.join(small(materialize(floors)), self.qid).filter("bm25 >= floor").select(self.qid, *self.keys, "bm25")


def bm25_topk(index, queries: DataFrame, keys: list[str], k: int = DEFAULT_TOP_K, qid: str = "query_id", qtext: str = "query",
              k1: float = BM25_K1, b: float = BM25_B, first: int = FIRST_RANGES, short: int = SHORT_QUERY) -> DataFrame:
    """The k best chunks of every query, exactly: ``qid, keys..., bm25, rank``.

    Long queries are scored by groups of ranges (``_grouped``): only each
    group's k best chunks leave it. Queries of at most ``short`` terms are
    answered without opening every block of their terms: the blocks' maxima,
    summed over a query's terms, bound the score of every chunk of a range. The
    ``first`` ranges with the largest bounds are scored; the k-th score found
    there is one that the result reaches at least, so the ranges whose bound
    lies below it are skipped: their postings meet no query.
    """
    qt = query_terms(queries, qid, qtext)
    sized = materialize(qt.groupBy(qid).agg((F.count(F.lit(1)) <= short).alias("_short")))
    n = {r["_short"]: r["count"] for r in sized.groupBy("_short").count().collect()}
    blocks, weighted, avgdl = _weighted(index, qt)
    found = [weighted.limit(0).select(qid, *[F.lit(None).cast("long").alias(c) for c in keys], F.lit(None).cast("double").alias("bm25"))]
    if n.get(False):
        long = weighted.join(sized.filter(~F.col("_short")), qid, "left_semi")
        found.append(_grouped(index, blocks, long, avgdl, n[False], qid, keys, k1, b, k=k).select(qid, *keys, "bm25"))
    if n.get(True):
        few = small(materialize(weighted.join(sized.filter("_short"), qid, "left_semi")))
        left = small(_reaching(blocks, few, avgdl, keys, k, qid, k1, b, first))
        found.append(_scored(blocks, few, avgdl, qid, keys, [], k1, b, ranges=left))
    return top_k(functools.reduce(DataFrame.unionByName, found), qid, "bm25", keys, k)


def _reaching(blocks: DataFrame, weighted: DataFrame, avgdl: Column, keys: list[str], k: int, qid: str,
              k1: float, b: float, first: int) -> DataFrame:
    """(query, range), written: the ranges that can hold one of the k best chunks of a query."""
    # the maximal weight of a block's postings: that of the shortest chunk of some frequency
    met = blocks.join(weighted, ["part", "term"]).withColumn("_avgdl", avgdl)
    most = F.array_max(F.transform("tops", lambda e: _tfn(e["tf"], e["dl"], F.col("_avgdl"), k1, b)))
    bounds = materialize(met.groupBy(qid, "range").agg(F.sum(F.col("idf") * most).alias("bound")))
    best = Window.partitionBy(qid).orderBy(F.desc("bound"), "range")
    begun = small(materialize(bounds.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= first).select(qid, "range")))
    scored = _scored(blocks, weighted, avgdl, qid, keys, [], k1, b, ranges=begun)
    kth = (top_k(scored, qid, "bm25", keys, k, rank_col="_r").groupBy(qid)
           .agg(F.min("bm25").alias("_kth"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k))
    # scores that are equal when rounded are ranked by their keys, so they stay
    slack = 10.0 ** -SCORE_DP
    return materialize(bounds.join(kth.select(qid, "_kth"), qid, "left").filter(
        F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - slack)).select(qid, "range"))


def top_k(scored: DataFrame, qid: str, score: str, tiebreak: list[str],
          k: Column | int = DEFAULT_TOP_K, rank_col: str = "rank") -> DataFrame:
    """#41: ``row_number() <= k`` per query (k may be a per-row column)."""
    w = Window.partitionBy(qid).orderBy(_round_rank(F.col(score)).desc(), *tiebreak)
    kc = F.lit(k) if isinstance(k, int) else k
    return (scored.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= kc))


# ------------------------------------------------------ exact vectors (#37)

def _l2_normalise(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


def vector_topk(items: DataFrame, queries: DataFrame, key: str, vec: str,
                qid: str, qvec: str, k: int = DEFAULT_TOP_K,
                item_block: int = 8192, query_block: int = 16_384, at_once: int = 512) -> DataFrame:
    """Exact cosine top-k per query: ``qid, key, score, vmin, vmax``.

    ``vmin``/``vmax`` are the per-query min and max cosine over all items
    (used by score fusion). Items and queries are hashed into blocks of at
    most about ``item_block`` / ``query_block`` rows; one cogroup per block
    pair takes ``at_once`` queries at a time, computes their dense product in
    numpy and keeps only its local top-k. An item crosses the network once
    for every ``query_block`` queries, in the type it is stored in. The block
    numbers come from scalar subqueries, so nothing runs before the plan does.
    Rows without a vector take no part.
    """
    def blocks(df: DataFrame, size: int) -> Column:
        n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        return F.greatest(F.lit(1), F.ceil(n / size)).cast("long")

    def dealt(df: DataFrame, name: str, v: str, own: str, n_own: Column, other: str, n_other: Column) -> DataFrame:
        out = df.select(F.col(name).alias("_id"), F.col(v).alias("_v"), n_own.alias("_n"), n_other.alias("_m"))
        out = out.filter("_v IS NOT NULL").withColumn(own, F.pmod(F.xxhash64("_id"), F.col("_n")))
        return out.select("_id", "_v", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias(other))

    ib, qb = blocks(items, item_block), blocks(queries, query_block)
    it = dealt(items, key, vec, "_ib", ib, "_qb", qb)
    qs = dealt(queries, qid, qvec, "_qb", qb, "_ib", ib)

    out_schema = T.StructType([
        T.StructField("_qid", T.LongType()), T.StructField("_key", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("vmin", T.DoubleType()),
        T.StructField("vmax", T.DoubleType())])

    def block_topk(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or ipdf.empty:
            return pd.DataFrame({c: [] for c in out_schema.fieldNames()})
        qm = _l2_normalise(np.vstack(qpdf["_v"].to_numpy()).astype(np.float64))
        im = _l2_normalise(np.vstack(ipdf["_v"].to_numpy()).astype(np.float64))
        keys = ipdf["_id"].to_numpy()
        kk = min(k, len(keys))
        picked, score, low, high = [], [], [], []
        for at in range(0, len(qm), at_once):
            sims = qm[at:at + at_once] @ im.T              # (queries, items)
            low.append(sims.min(axis=1))
            high.append(sims.max(axis=1))
            for s in sims:
                sr = np.round(s, SCORE_DP)      # same order as the final ranking
                if kk < len(s):
                    cand = np.nonzero(sr >= np.partition(sr, len(sr) - kk)[len(sr) - kk])[0]
                else:
                    cand = np.arange(len(s))
                # order: score desc, key asc (lexsort uses the last key as primary)
                best = cand[np.lexsort((keys[cand], -sr[cand]))][:kk]
                picked.append(keys[best])
                score.append(s[best])
        return pd.DataFrame({"_qid": np.repeat(qpdf["_id"].to_numpy(), kk), "_key": np.concatenate(picked),
                             "score": np.concatenate(score), "vmin": np.repeat(np.concatenate(low), kk),
                             "vmax": np.repeat(np.concatenate(high), kk)})

    local = (qs.groupBy("_qb", "_ib").cogroup(it.groupBy("_qb", "_ib"))
             .applyInPandas(block_topk, out_schema))
    stats = Window.partitionBy("_qid")
    ranked = (local.withColumn("vmin", F.min("vmin").over(stats))
                   .withColumn("vmax", F.max("vmax").over(stats)))
    best = top_k(ranked, "_qid", "score", ["_key"], k, rank_col="_r").drop("_r")
    return best.withColumnRenamed("_qid", qid).withColumnRenamed("_key", key)


def unit(a: Column) -> Column:
    """Array scaled to unit L2 norm (double)."""
    ad = a.cast("array<double>")
    n = F.sqrt(F.aggregate(ad, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(ad, lambda x: x / n)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length double arrays (cosine of unit vectors)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays, in double (JVM-side)."""
    ad = a.cast("array<double>")
    bd = b.cast("array<double>")
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(ad, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(bd, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (na * nb)


# ------------------------------------------------------------ alpha (#39)

def pick_alpha(q) -> Column:
    """Keyword/vector weight: filename -> 0, quoted -> 0, <=3 words -> .3, else .7."""
    q = F.col(q) if isinstance(q, str) else q
    n_words = F.size(F.filter(F.split(q, WS + "+"), lambda w: w != ""))
    return (F.when(q.rlike(FILENAME_QUERY), F.lit(0.0))
             .when(q.startswith('"') & q.endswith('"'), F.lit(0.0))
             .when(n_words <= 3, F.lit(0.3))
             .otherwise(F.lit(0.7)))


# ---------------------------------------------------------- hybrid (#40)

def _minmax(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max scale into [0, 1]; a constant side scales to 1."""
    return F.when(hi == lo, F.lit(1.0)).otherwise((x - lo) / (hi - lo))


def hybrid_scores(bm25: DataFrame, vec_top: DataFrame, pair_cos: DataFrame,
                  alphas: DataFrame, qid: str, keys: list[str]) -> DataFrame:
    """Relative-score fusion ``alpha*vec + (1-alpha)*bm25`` per query.

    bm25      : qid, keys..., bm25              (every keyword candidate)
    vec_top   : qid, keys..., cos, vmin, vmax   (vector top-k candidates)
    pair_cos  : qid, keys..., cos               (cosine of keyword candidates; absent = no vector)
    alphas    : qid, alpha, vmin, vmax          (per-query weight and vector range)

    Each side is min-max scaled over the query's candidates of that side,
    a missing side counts 0, alpha = 0 keeps keyword candidates only. Keeping
    the vector side to its top-k is exact: an item outside both candidate sets
    scores alpha*nv, which cannot beat any of the k vector leaders.
    """
    brange = bm25.groupBy(qid).agg(F.min("bm25").alias("bmin"), F.max("bm25").alias("bmax"))
    kw = (bm25.join(pair_cos, [qid, *keys], "left")
              .select(qid, *keys, "bm25", "cos"))
    vt = vec_top.select(qid, *keys, "cos").join(alphas.filter(F.col("alpha") > 0).select(qid), qid, "left_semi")
    cand = (kw.join(vt.withColumnRenamed("cos", "vcos"), [qid, *keys], "full_outer")
              .select(qid, *keys, "bm25", F.coalesce("cos", "vcos").alias("cos")))
    cand = cand.join(alphas, qid).join(brange, qid, "left")
    nb = F.when(F.col("bm25").isNull(), F.lit(0.0)).otherwise(_minmax(F.col("bm25"), F.col("bmin"), F.col("bmax")))
    nv = F.when(F.col("cos").isNull(), F.lit(0.0)).otherwise(_minmax(F.col("cos"), F.col("vmin"), F.col("vmax")))
    fused = F.when(F.col("alpha") == 0, nb).otherwise(F.col("alpha") * nv + (1 - F.col("alpha")) * nb)
    return cand.select(qid, *keys, "alpha", "bm25", "cos", fused.alias("score"))


# ------------------------------------------------- request checks (#42)

def validate_request(req: DataFrame, top_k_col: str = "top_k", mode_col: str = "mode",
                     response_mode_col: str = "response_mode", query_col: str = "query") -> DataFrame:
    """Adds ``k``, ``resolved_mode`` and ``error`` (null when valid).

    ``top_k_col`` is text as it arrived (null, digits, 'true', ...). Order of
    checks: empty query, then mode, then k.
    """
    raw_k = F.col(top_k_col)
    k_num = F.expr(f"try_cast(trim({top_k_col}) as int)")
    is_bool = F.lower(F.trim(raw_k)).isin("true", "false")
    k = F.when(raw_k.isNull(), F.lit(DEFAULT_TOP_K)).when(is_bool | k_num.isNull(), F.lit(DEFAULT_TOP_K)) \
         .when((k_num < MIN_TOP_K) | (k_num > MAX_TOP_K), F.lit(DEFAULT_TOP_K)).otherwise(k_num)
    k_err = (F.when(raw_k.isNull(), F.lit(None))
             .when(is_bool, F.lit("Invalid top_k type: expected integer, got bool"))
             .when(k_num.isNull(), F.concat(F.lit("Invalid top_k: expected integer, got '"), raw_k, F.lit("'")))
             .when((k_num < MIN_TOP_K) | (k_num > MAX_TOP_K),
                   F.lit(f"Invalid top_k value: must be between {MIN_TOP_K} and {MAX_TOP_K}")))
    requested = F.coalesce(F.col(response_mode_col), F.col(mode_col))
    norm = F.lower(F.trim(requested))
    alias = F.lit(None).cast("string")
    for name, target in reversed(list(MODE_ALIASES.items())):
        alias = F.when(norm == name, F.lit(target)).otherwise(alias)
    mode = F.when(requested.isNull(), F.lit(DEFAULT_RESPONSE_MODE)).otherwise(alias)
    mode_err = F.when(requested.isNotNull() & alias.isNull(),
                      F.lit("Invalid response_mode: expected one of synthesis, raw, both"))
    q = F.col(query_col)
    q_err = F.when(q.isNull() | (F.trim(q) == "") | q.rlike(r"^\s*$"), F.lit("Empty query provided"))
    return req.select("*", k.alias("k"), mode.alias("resolved_mode"),
                      F.coalesce(q_err, mode_err, k_err).alias("error"))


# --------------------------------------------------- inventory (#43)

def list_documents(chunks: DataFrame) -> DataFrame:
    """One row per filename: chunk_count and ingested_at of its first chunk."""
    fn = F.coalesce(F.col("source_filename"), F.lit("unknown"))
    first = F.struct(F.col("chunk_index"), F.col("total_chunks"), F.col("ingested_at"))
    return (chunks.groupBy(fn.alias("filename"))
            .agg(F.min_by(first, F.coalesce(F.col("chunk_index"), F.lit(2**31 - 1))).alias("_f"))
            .select("filename", F.col("_f.total_chunks").alias("chunk_count"),
                    F.coalesce(F.col("_f.ingested_at"), F.lit("unknown")).alias("ingested_at")))


def score_threshold(df: DataFrame, score: str = "score", t: float = DEFAULT_THRESHOLD) -> DataFrame:
    """#11: keep scored rows at or above the threshold (null never passes)."""
    return df.filter(F.col(score).isNotNull() & (F.col(score) >= t))


def filename_filter(df: DataFrame, filename_col: str, wanted_col: str) -> DataFrame:
    """#10: exact equality on the file name; a null wanted name keeps all rows.

    With a literal name this is a plain ``filter`` that Catalyst pushes into
    the Parquet scan of a stored chunk table; per query it is a join key."""
    return df.filter(F.col(wanted_col).isNull() | (F.col(filename_col) == F.col(wanted_col)))


#: Depth of the keyword and vector lists that ``hybrid_topk`` reads first, in times of k.
LIST_DEPTH = 8
#: Rows up to which a table that several joins of a search meet is broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A materialised table, to be broadcast if it has ``SMALL_ROWS`` rows at most."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def hybrid_topk(scores, listed: DataFrame, cos_of, alphas: DataFrame, k: int = DEFAULT_TOP_K,
                depth: int | None = None) -> DataFrame:
    """#40/#41 exact fused top-k by a threshold merge of two ranked lists.

    scores  : ``IndexScores`` or ``TableScores``: the keyword candidates, their qid and keys
    listed  : qid, keys..., cos     the ``depth`` nearest candidates of the queries with alpha > 0
    cos_of  : DataFrame(qid, keys...) -> same + ``cos`` (rows without a vector dropped)
    alphas  : qid, alpha, vmin, vmax

    The first ``depth`` entries of both lists are fused exactly (each list's
    entries are looked up in the other one); their k-th best score tau is one
    that the result reaches at least. A candidate further down has at most the
    cosine at which its query's vector list ends, so it can only matter if
    ``alpha * nv_end + (1 - alpha) * nb >= tau``: a floor for its keyword score.
    Only candidates above it leave their task, and only those get a cosine; no
    join or shuffle has a row for every (query, candidate). Ties are kept, so
    the result equals fusing every candidate.
    """
    qid, keys, depth = scores.qid, scores.keys, depth or LIST_DEPTH * k
    pair = [qid, *keys]
    listed = materialize(listed.select(*pair, "cos"))
    leaders, brange = scores.best(depth)
    leaders = materialize(leaders)
    ends = listed.groupBy(qid).agg(F.min("cos").alias("_end"), F.count(F.lit(1)).alias("_listed"))
    per_query = small(materialize(alphas.join(brange, qid, "left").join(ends, qid, "left")))

    def fused(df: DataFrame) -> DataFrame:
        """qid, keys, bm25, cos (either may be null) -> + alpha, score."""
        c = df.join(per_query, qid)
        nb = F.when(F.col("bm25").isNull(), F.lit(0.0)).otherwise(_minmax(F.col("bm25"), F.col("bmin"), F.col("bmax")))
        nv = F.when(F.col("cos").isNull(), F.lit(0.0)).otherwise(_minmax(F.col("cos"), F.col("vmin"), F.col("vmax")))
        score = F.when(F.col("alpha") == 0, nb).otherwise(F.col("alpha") * nv + (1 - F.col("alpha")) * nb)
        return c.select(*pair, "alpha", "bm25", "cos", score.alias("score"))

    def with_cos(df: DataFrame) -> DataFrame:
        return df.join(cos_of(df.select(*pair)), pair, "left").select(*pair, "bm25", "cos")

    known = listed.join(materialize(scores.of(listed)), pair, "left").select(*pair, "bm25", "cos")
    fresh = leaders.join(listed.select(*pair), pair, "left_anti")
    seeds = materialize(fused(known.unionByName(with_cos(fresh))))
    kth = (top_k(seeds, qid, "score", keys, k, rank_col="_r").groupBy(qid)
           .agg(F.min("score").alias("_tau"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k))
    # a list that ended early holds every vector: what it lacks has none
    most = F.when(F.col("_listed") >= depth, _minmax(F.col("_end"), F.col("vmin"), F.col("vmax"))).otherwise(F.lit(0.0))
    most = F.when(F.col("alpha") == 0, F.lit(0.0)).otherwise(F.col("alpha") * F.coalesce(most, F.lit(0.0)))
    # scores that are equal when rounded are ranked by their keys, so they stay
    need = F.col("_tau") - 10.0 ** -SCORE_DP - most
    span = F.col("bmax") - F.col("bmin")
    floor = (F.when(F.col("_tau").isNull() | (need <= 0), F.lit(float("-inf")))
             .when(F.col("alpha") == 1, F.lit(float("inf")))
             .when(span == 0, F.when(need <= 1 - F.col("alpha"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
             .otherwise(F.col("bmin") + need / (1 - F.col("alpha")) * span - 1e-9 * F.col("bmax")))
    floors = materialize(per_query.join(kth.select(qid, "_tau"), qid, "left").filter("bmin IS NOT NULL")
                         .select(qid, floor.alias("floor")))
    further = materialize(scores.above(floors))
    unseen = further.join(small(seeds.select(*pair)), pair, "left_anti")
    return top_k(seeds.unionByName(fused(with_cos(unseen))), qid, "score", keys, k)
