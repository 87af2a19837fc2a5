"""Hybrid document search over whole query tables (entry point A).

Query table = ``benchmark`` (item_id -> query_id, text -> query); chunk store
= ``documents`` run through the ingest operators; vectors = ``embeddings``
(a chunk uses the vector of its document, ``vec_id = doc_id``; a query uses
``vec_id = item_id``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import index as IX
from corpuskit.operators import prepare, results, retrieval
from corpuskit.session import checkpoint_dir, materialize
from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import (
    INGESTED_AT, bm25_cte, chunks_cte, sql_str, tokens_sql,
)
from corpuskit.tables import Tables

KEYS = ["doc_id", "chunk_index"]


def chunk_store(t: Tables) -> DataFrame:
    return prepare.prepare_chunks(t.documents, INGESTED_AT)


def query_table(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: (application, folder of the tables, version of documents) -> the written index
_INDEXES: dict[tuple, IX.SearchIndex] = {}


def ingest(t: Tables) -> IX.SearchIndex:
    """Write the search index of ``documents`` into a new folder under the shared
    checkpoint folder; the session's later searches read it."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/search-index-{uuid.uuid4().hex}"
    index = IX.write_index(chunk_store(t), folder, KEYS)
    _INDEXES[_index_key(t)] = index
    return index


def _index_key(t: Tables) -> tuple:
    return (t.spark.conf.get("spark.app.id"), t.sf_dir, *IX.source_version(t.spark, f"{t.sf_dir.rstrip('/')}/documents.parquet"))


def search_index(t: Tables) -> IX.SearchIndex:
    """The stored index of ``documents``: written by the session's first search,
    and again when the table's files have changed."""
    return _INDEXES.get(_index_key(t)) or ingest(t)


Q_CTE = "_q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
SHORT_Q_CTE = "_q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS query FROM benchmark)"

# ------------------------------------------------------------------ chunks

@register("chunk_words", sql=f"""
WITH {chunks_cte()}
SELECT doc_id, source_filename, chunk_index, total_chunks, page_number, length(content) AS n_chars,
       md5(content) AS content_md5
FROM chunks""")
def q_chunk_words(t: Tables) -> DataFrame:
    """#26/#27: 400-word windows with 40 overlap, numbered per file."""
    c = chunk_store(t)
    return c.select("doc_id", "source_filename", F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col("total_chunks").cast("long").alias("total_chunks"),
                    F.col("page_number").cast("long").alias("page_number"),
                    F.length("content").cast("long").alias("n_chars"),
                    F.md5("content").alias("content_md5"))


# ------------------------------------------------------------------- BM25

@register("build_index", sql=f"""
WITH {Q_CTE}, {chunks_cte()}, {bm25_cte()}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n_tokens FROM _post GROUP BY term""")
def q_build_index(t: Tables) -> DataFrame:
    """#5/#35: ingest: chunks and postings written anew; per term its chunks and tokens."""
    p = ingest(t).blocks.filter(F.col("term").isNotNull())
    return p.groupBy("term").agg(F.sum("n").alias("df"), F.sum("n_tokens").alias("n_tokens"))


def bm25_topk_df(t: Tables, k=retrieval.DEFAULT_TOP_K, with_content: bool = False) -> DataFrame:
    index = search_index(t)
    best = retrieval.bm25_topk(index, query_table(t), KEYS, k).withColumn("score", F.col("bm25"))
    return with_chunks(index, best) if with_content else best


def with_chunks(index: IX.SearchIndex, best: DataFrame) -> DataFrame:
    """The rows of a ranking with their chunks: the texts of the others are not shuffled."""
    return retrieval.small(materialize(best)).join(index.chunks, KEYS)


BM25_TOPK_SQL = f"""
WITH {Q_CTE}, {chunks_cte()}, {bm25_cte()},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id, chunk_index) AS rank
  FROM bm25
)
SELECT r.query_id, CAST(r.rank AS BIGINT) AS rank, r.doc_id, c.chunk_index, round(r.bm25, 4) AS score
FROM ranked r JOIN chunks c USING (doc_id, chunk_index)
WHERE r.rank <= 5"""


@register("bm25_topk", sql=BM25_TOPK_SQL)
def q_bm25_topk(t: Tables) -> DataFrame:
    """#35/#36/#41: keyword top-5 per benchmark query."""
    return bm25_topk_df(t).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                                  F.col("chunk_index").cast("long").alias("chunk_index"),
                                  F.round("score", 4).alias("score"))


RAW_SQL = f"""
WITH {Q_CTE}, {chunks_cte()}, {bm25_cte()},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id, chunk_index) AS rank
  FROM bm25
)
SELECT r.query_id, CAST(r.rank AS BIGINT) AS rank,
       sha256(concat_ws(chr(1), c.source_filename, CAST(c.chunk_index AS VARCHAR), c.content)) AS chunk_id,
       c.content, round(r.bm25, 4) AS score, c.source_filename AS filename,
       CAST(c.chunk_index AS BIGINT) AS chunk_index, CAST(c.total_chunks AS BIGINT) AS total_chunks,
       CAST(c.page_number AS BIGINT) AS page, CAST(NULL AS VARCHAR) AS section,
       '' AS room_id, '' AS sender, {sql_str(INGESTED_AT)} AS ingested_at
FROM ranked r JOIN chunks c USING (doc_id, chunk_index)
WHERE r.rank <= 5"""


@register("raw_results", sql=RAW_SQL)
def q_raw_results(t: Tables) -> DataFrame:
    """Flagship: documents -> #9 -> #8 -> #26 -> #27 -> #35 -> #36 -> #41 -> #44."""
    best = bm25_topk_df(t, with_content=True)
    best = best.withColumn("id", prepare.chunk_sha(F.col("source_filename"), F.col("chunk_index"),
                                                     F.col("content")))
    return results.raw_results(best.withColumn("score", F.round("score", 4))).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "content", "score",
        "filename", "chunk_index", "total_chunks", "page", "section", "room_id", "sender",
        "ingested_at")


@register("bm25_topk_short", sql=BM25_TOPK_SQL.replace(Q_CTE, SHORT_Q_CTE))
def q_bm25_topk_short(t: Tables) -> DataFrame:
    """#36/#41: keyword top-5 of the first three words of each benchmark text (ranges out of reach are skipped)."""
    queries = query_table(t).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 3), " "))
    best = retrieval.bm25_topk(search_index(t), queries, KEYS)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                       F.col("chunk_index").cast("long").alias("chunk_index"), F.round("bm25", 4).alias("score"))


@register("tokenize", sql=f"""
WITH {chunks_cte()}
SELECT doc_id, chunk_index, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms,
       md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, chunk_index, {tokens_sql('content')} AS t FROM chunks)""")
def q_tokenize(t: Tables) -> DataFrame:
    """#35: the tokens of each chunk, counted and hashed in order."""
    from corpuskit.functions.text import tokens
    c = chunk_store(t).select("doc_id", "chunk_index", tokens("content").alias("t"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.size("t").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("long").alias("n_terms"),
                    F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# ----------------------------------------------------------------- vectors

def query_vectors(t: Tables) -> DataFrame:
    e = t.embeddings
    return (query_table(t).join(e, F.col("query_id") == F.col("vec_id"))
            .select("query_id", F.col("embedding").alias("qv")))


VEC_SQL = """
WITH qv AS (SELECT b.item_id AS query_id, e.embedding AS qv FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
s AS (SELECT qv.query_id, e.vec_id,
             list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(qv.qv AS DOUBLE[])) AS score
      FROM qv CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 5"""


@register("vector_topk", sql=VEC_SQL)
def q_vector_topk(t: Tables) -> DataFrame:
    """#37: exact cosine top-5 of every benchmark query's vector."""
    best = retrieval.vector_topk(t.embeddings, query_vectors(t), "vec_id", "embedding",
                                 "query_id", "qv", k=5)
    ranked = retrieval.top_k(best, "query_id", "score", ["vec_id"], 5)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id",
                         F.round("score", 4).alias("score"))


# ------------------------------------------------------------------ alpha

def alpha_sql(q: str) -> str:
    return (f"CAST(CASE WHEN regexp_matches({q}, '{retrieval.FILENAME_QUERY}') THEN 0.0 "
            f"WHEN starts_with({q}, '\"') AND ends_with({q}, '\"') THEN 0.0 "
            f"WHEN len(list_filter(regexp_split_to_array({q}, '{retrieval.WS}+'), lambda w: w <> '')) <= 3 THEN 0.3 "
            f"ELSE 0.7 END AS DOUBLE)")


ALPHA_SQL = f"""
WITH v AS (
  SELECT item_id AS query_id, 'text' AS form, text AS query FROM benchmark
  UNION ALL SELECT item_id, 'quoted', '"' || text || '"' FROM benchmark
  UNION ALL SELECT item_id, 'filename', regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g') || '.pdf' FROM benchmark
  UNION ALL SELECT item_id, 'first_word', split_part(trim(text), ' ', 1) FROM benchmark
)
SELECT query_id, form, {alpha_sql('query')} AS alpha FROM v"""


@register("pick_alpha", sql=ALPHA_SQL)
def q_pick_alpha(t: Tables) -> DataFrame:
    """#39: keyword/vector weight of each benchmark query in four shapes."""
    b = t.benchmark
    forms = [
        b.select(F.col("item_id").alias("query_id"), F.lit("text").alias("form"), F.col("text").alias("query")),
        b.select("item_id", F.lit("quoted"), F.concat(F.lit('"'), "text", F.lit('"'))),
        b.select("item_id", F.lit("filename"),
                 F.concat(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "_"), F.lit(".pdf"))),
        b.select("item_id", F.lit("first_word"), F.split_part(F.trim("text"), F.lit(" "), F.lit(1))),
    ]
    v = forms[0]
    for f in forms[1:]:
        v = v.union(f)
    return v.select("query_id", "form", retrieval.pick_alpha("query").alias("alpha"))


# ----------------------------------------------------------------- hybrid

def hybrid_df(t: Tables, k: int = retrieval.DEFAULT_TOP_K, merged: bool = True) -> DataFrame:
    """Hybrid top-k per benchmark query over the stored index.

    ``merged=True`` merges the keyword and the vector list and computes cosines
    only for candidates that can still reach the top-k; ``merged=False`` fuses
    every keyword candidate. Both are exact.
    """
    index = search_index(t)
    chunks = index.chunks
    queries = query_table(t).withColumn("alpha", retrieval.pick_alpha("query"))
    qv = query_vectors(t).join(queries.filter("alpha > 0").select("query_id"), "query_id", "left_semi")
    kept_docs = chunks.filter(F.col("chunk_index") == 0).select("doc_id")
    items = t.embeddings.join(kept_docs, F.col("vec_id") == F.col("doc_id"), "left_semi")
    depth = retrieval.LIST_DEPTH * k if merged else k
    # the nearest documents of each query and its smallest and largest cosine
    near = materialize(retrieval.vector_topk(items, qv, "vec_id", "embedding", "query_id", "qv", k=depth))
    listed = (near.join(chunks.select(*KEYS), F.col("vec_id") == F.col("doc_id"))
              .withColumnRenamed("score", "cos"))
    listed = retrieval.top_k(listed, "query_id", "cos", KEYS, depth, rank_col="_r").drop("_r")
    ranges = near.groupBy("query_id").agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
    alphas = queries.select("query_id", "alpha").join(ranges, "query_id", "left")

    def cos_of(pairs: DataFrame) -> DataFrame:
        """Per (query, document): chunks share their document's vector."""
        docs = pairs.select("query_id", "doc_id").distinct()
        dc = (docs.join(qv, "query_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
              .select("query_id", "doc_id", retrieval.cosine(F.col("embedding"), F.col("qv")).alias("cos")))
        return pairs.join(dc, ["query_id", "doc_id"])

    if merged:
        return retrieval.hybrid_topk(retrieval.IndexScores(index, queries, KEYS), listed, cos_of, alphas, k, depth)
    bm25 = retrieval.bm25_search(index, queries, KEYS)
    fused = retrieval.hybrid_scores(bm25, listed, cos_of(bm25.select("query_id", *KEYS)), alphas, "query_id", KEYS)
    return retrieval.top_k(fused, "query_id", "score", KEYS, k)


def hybrid_sql(k: int = 5, extra_cols: str = "", where: str = "") -> str:
    return f"""
WITH {hybrid_ctes()}
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index,
       alpha, round(score, 4) AS score {extra_cols}
FROM ranked r WHERE rank <= {k} {where}"""


def hybrid_ctes() -> str:
    """CTEs ending in ``ranked(query_id, doc_id, chunk_index, alpha, score, rank, ...)`` and ``chunks``."""
    return f"""{Q_CTE}, {chunks_cte()}, {bm25_cte()},
qv AS (SELECT b.item_id AS query_id, e.embedding AS qv FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
al AS (SELECT query_id, {alpha_sql('query')} AS alpha FROM _q),
vc AS (
  SELECT qv.query_id, c.doc_id, c.chunk_index,
         list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(qv.qv AS DOUBLE[])) AS cos
  FROM qv JOIN al USING (query_id) CROSS JOIN chunks c JOIN embeddings e ON e.vec_id = c.doc_id
  WHERE al.alpha > 0
),
vr AS (SELECT query_id, min(cos) AS vmin, max(cos) AS vmax FROM vc GROUP BY query_id),
br AS (SELECT query_id, min(bm25) AS bmin, max(bm25) AS bmax FROM bm25 GROUP BY query_id),
cand AS (
  SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS doc_id,
         coalesce(b.chunk_index, v.chunk_index) AS chunk_index, b.bm25, v.cos
  FROM bm25 b FULL OUTER JOIN vc v
    ON b.query_id = v.query_id AND b.doc_id = v.doc_id AND b.chunk_index = v.chunk_index
),
fused AS (
  SELECT c.*, a.alpha,
         CASE WHEN c.bm25 IS NULL THEN 0.0 WHEN br.bmax = br.bmin THEN 1.0
              ELSE (c.bm25 - br.bmin) / (br.bmax - br.bmin) END AS nb,
         CASE WHEN c.cos IS NULL THEN 0.0 WHEN vr.vmax = vr.vmin THEN 1.0
              ELSE (c.cos - vr.vmin) / (vr.vmax - vr.vmin) END AS nv
  FROM cand c JOIN al a USING (query_id) LEFT JOIN br USING (query_id) LEFT JOIN vr USING (query_id)
),
scored AS (
  SELECT *, CASE WHEN alpha = 0 THEN nb ELSE alpha * nv + (1 - alpha) * nb END AS score FROM fused
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, chunk_index) AS rank
  FROM scored
)"""


@register("hybrid_topk", sql=hybrid_sql())
def q_hybrid_topk(t: Tables) -> DataFrame:
    """#40: relative-score fusion of BM25 and cosine, top-5 per query."""
    return hybrid_df(t).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                               F.col("chunk_index").cast("long").alias("chunk_index"), "alpha",
                               F.round("score", 4).alias("score"))
