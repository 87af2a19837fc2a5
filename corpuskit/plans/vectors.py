"""Embedding and approximate-neighbour queries (#33, #38, #74 near).

The embedder's oracle checks dimension and norm. Approximate search has no DuckDB
equivalent; tests compare it with the exact one (recall). Near-duplicate classes
are exact, so the oracle compares every pair.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import cells as C
from corpuskit.operators import embed as E
from corpuskit.operators import index as IX
from corpuskit.operators import setjoin as S
from corpuskit.operators import vectors as V
from corpuskit.operators import web
from corpuskit.plans.registry import register
from corpuskit.plans.search import KEYS, chunk_store, query_table, query_vectors, search_index
from corpuskit.plans.sqlparts import NORM_SQL, chunks_cte, tokens_sql
from corpuskit.session import checkpoint_dir
from corpuskit.tables import Tables


@register("embed_chunks", sql=f"""
WITH {chunks_cte()}
SELECT doc_id, chunk_index, {V.EMBED_DIM} AS dim, CASE WHEN len({tokens_sql('content')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM chunks""")
def q_embed_chunks(t: Tables) -> DataFrame:
    """#33: every chunk -> 64-dim unit vector (JVM-side hashing embedder)."""
    e = V.embed_hashed(chunk_store(t), "content")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("embedding").alias("dim"), F.round(norm, 6).alias("norm"))


def _vectors_sql(rows: str, counts: str, key: str) -> str:
    """CTEs ending in ``_vec(key, v)``: the vectors of ``rows`` by their term counts, weighted by ``_df`` and ``_stats``."""
    return f"""
_fit AS (SELECT term, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {E.DIM} AS place,
                CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END
                * (ln((1 + s.n) / (1 + d.df)) + 1) AS weight FROM _df d CROSS JOIN _stats s),
_sum AS (SELECT {key}, place, sum(tf * weight) AS w FROM {counts} JOIN _fit USING (term) GROUP BY {key}, place),
_grid AS (SELECT {key}, place FROM (SELECT {key} FROM {rows}) CROSS JOIN (SELECT unnest(range(0, {E.DIM})) AS place)),
_dense AS (SELECT {key}, place, coalesce(w, 0.0) AS w FROM _grid LEFT JOIN _sum USING ({key}, place)),
_vec AS (SELECT {key}, list(w ORDER BY place) AS v, sqrt(sum(w * w)) AS n FROM _dense GROUP BY {key})"""


_ROUNDED_SQL = ("array_to_string(list_transform(v, lambda x: CAST(CAST(CASE WHEN n > 0 THEN round(10000 * (x / n)) ELSE 0 END "
                "AS BIGINT) AS VARCHAR)), ',')")


def rounded(v: str) -> Column:
    """A vector as text, in units of 0.0001 (so that engines compare)."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 10000).cast("long").cast("string")), ",")


def fitted_embedder(t: Tables) -> DataFrame:
    """The embedder's weights, fitted on the stored index of ``documents``."""
    index = search_index(t)
    return E.fit(index.terms.select("term", "df"), index.stats.select("n_docs").scalar())


@register("embed_fitted", sql=f"""
WITH {chunks_cte()},
_toks AS (SELECT doc_id, chunk_index, {tokens_sql('content')} AS t FROM chunks),
_stats AS (SELECT count(*) AS n FROM _toks),
_post AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest(t) AS term FROM _toks) GROUP BY ALL),
_df AS (SELECT term, count(*) AS df FROM _post GROUP BY term), {_vectors_sql('chunks', '_post', 'doc_id, chunk_index')}
SELECT doc_id, chunk_index, {_ROUNDED_SQL} AS vector FROM _vec""")
def q_embed_fitted(t: Tables) -> DataFrame:
    """#33: every chunk's vector under weights fitted on all chunks."""
    index = search_index(t)
    counts = index.blocks.select("term", *[F.col(f"{IX.ENTRY}{c}").alias(c) for c in (*KEYS, "tf")])
    e = E.embed_terms(index.chunks, counts, fitted_embedder(t), KEYS)
    return e.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), rounded("embedding").alias("vector"))


@register("embed_queries", sql=f"""
WITH {chunks_cte()},
_toks AS (SELECT doc_id, chunk_index, {tokens_sql('content')} AS t FROM chunks),
_stats AS (SELECT count(*) AS n FROM _toks),
_df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, chunk_index, unnest(t) AS term FROM _toks) GROUP BY term),
_q AS (SELECT item_id AS query_id, text FROM benchmark),
_qc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({tokens_sql('text')}) AS term FROM _q) GROUP BY ALL),
{_vectors_sql('_q', '_qc', 'query_id')}
SELECT query_id, {_ROUNDED_SQL} AS vector FROM _vec""")
def q_embed_queries(t: Tables) -> DataFrame:
    """#33: the benchmark queries' vectors under the same weights as the chunks'."""
    e = E.embed_texts(query_table(t), "query", fitted_embedder(t), ["query_id"])
    return e.select("query_id", rounded("embedding").alias("vector"))


#: (application, folder of the tables, version of embeddings) -> folder of the written cells
_CELLS: dict[tuple, str] = {}


def vector_cells(t: Tables) -> C.VectorCells | None:
    """The stored cells of ``embeddings``: written by the session's first approximate
    search, and again when the table's files have changed."""
    path = f"{t.sf_dir.rstrip('/')}/embeddings.parquet"
    name = (t.spark.conf.get("spark.app.id"), t.sf_dir, *IX.source_version(t.spark, path))
    if name not in _CELLS:
        folder = f"{checkpoint_dir(t.spark).rstrip('/')}/vector-cells-{uuid.uuid4().hex}"
        if C.write_cells(t.embeddings, "vec_id", "embedding", folder) is None:
            return None
        _CELLS[name] = folder
    return C.open_cells(t.spark, _CELLS[name])


@register("vector_topk_approx", note="stored cells with compressed codes; rows-only, recall tested against vector_topk")
def q_vector_topk_approx(t: Tables) -> DataFrame:
    """#38: approximate top-5 neighbours of every benchmark query vector."""
    index = vector_cells(t)
    if index is None:
        return t.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    r = C.search(index, query_vectors(t), "query_id", "qv", "vec_id", k=5)
    return r.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


NEAR_DISTANCE = 0.3

_NEAR_SQL = f"""
WITH RECURSIVE _d AS (
  SELECT min(doc_id) AS doc_id, min_by(text, doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY {NORM_SQL}),
_s AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS t FROM _d),
_t AS (SELECT doc_id, len(t) AS n, unnest(t) AS tok FROM _s),
_p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM _t a JOIN _t b ON a.tok = b.tok AND a.doc_id < b.doc_id
   AND least(a.n, b.n) >= {1 - NEAR_DISTANCE} * greatest(a.n, b.n) - 1e-9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= {1 - NEAR_DISTANCE} - 1e-9),
_e AS (SELECT a, b FROM _p UNION ALL SELECT b, a FROM _p),
_r AS (SELECT a AS v, a AS r FROM _e UNION SELECT _e.b, _r.r FROM _r JOIN _e ON _e.a = _r.v),
_c AS (SELECT v, min(r) AS r FROM _r GROUP BY v)
SELECT v AS doc_id, r AS rep_doc_id, count(*) OVER (PARTITION BY r) AS class_size FROM _c"""


@register("near_duplicates", sql=_NEAR_SQL)
def q_near_duplicates(t: Tables) -> DataFrame:
    """#74 near: the distinct texts that are near duplicates (Jaccard distance <= 0.3) of others, with their class."""
    d = t.documents.filter(F.col("text").isNotNull())
    keep = web.exact_dedupe(d, "doc_id", "text").select("doc_id")
    return S.near_duplicate_classes(d, "doc_id", "text", NEAR_DISTANCE, within=keep)
