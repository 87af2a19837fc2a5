"""Ingest-side queries (entry point B): blanks, whitespace, pre-split,
chunk positions, pages, keys, store schema, replace-by-filename, summary.

Inputs with blanks / form feeds / whitespace runs are derived from every
``documents`` row by a fixed rule on ``doc_id % 7`` (all rows kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import clean_document, collapse_whitespace, html_to_text
from corpuskit.operators import prepare, retrieval, store
from corpuskit.plans.registry import register
from corpuskit.plans.search import KEYS, chunk_store, query_table, search_index
from corpuskit.plans.sqlparts import (
    BLANK_SQL, INGESTED_AT, bm25_cte, chunks_cte, chunks_cte_from, collapse_sql, html_to_text_sql, sql_str,
)
from corpuskit.tables import Tables

# Shared Spark/DuckDB expression: every document, some with injected
# trailing newlines, tab/space runs, form feeds, whitespace-only text.
VARIANT_TEXT = (
    "CASE doc_id % 7 "
    "WHEN 1 THEN text || chr(10) || chr(10) || chr(10) || chr(10) || 'Tail  line' "
    "WHEN 2 THEN text || '  ' || chr(9) || '  spaced   out' "
    "WHEN 3 THEN replace(text, '. ', '.' || chr(12) || ' ') "
    "WHEN 4 THEN ' ' || chr(9) || chr(10) || ' ' "
    "WHEN 5 THEN chr(10) || '   ' || chr(10) || text || chr(10) || chr(10) || '  ' || chr(10) || 'end' "
    "ELSE text END")


def variant_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", F.expr(VARIANT_TEXT).alias("text"))


VARIANT_SQL = f"_docs AS (SELECT doc_id, source, {VARIANT_TEXT} AS text FROM documents)"


def _on_variant(cte: str) -> str:
    """Point a documents-based CTE at the variant documents."""
    return cte.replace("FROM documents", "FROM _docs")


@register("collapse_whitespace", sql=f"""
WITH {VARIANT_SQL}
SELECT doc_id, length({collapse_sql('text')}) AS n_chars, md5({collapse_sql('text')}) AS text_md5 FROM _docs""")
def q_collapse_whitespace(t: Tables) -> DataFrame:
    """#8: newline runs then space/tab runs collapsed."""
    c = collapse_whitespace("text")
    return variant_docs(t).select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("text_md5"))


@register("drop_empty", sql=f"""
WITH {VARIANT_SQL}
SELECT doc_id, (text IS NULL OR regexp_matches(text, {BLANK_SQL})) AS rejected,
       CASE WHEN text IS NULL OR regexp_matches(text, {BLANK_SQL}) THEN 'Empty text provided' END AS error
FROM _docs""")
def q_drop_empty(t: Tables) -> DataFrame:
    """#9: blank texts become error rows (kept + rejected = all rows)."""
    kept, rejected = prepare.drop_empty(variant_docs(t))
    return (kept.select("doc_id", F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("error"))
            .unionByName(rejected.select("doc_id", F.lit(True).alias("rejected"), "error")))


def _clean_sql(x: str) -> str:
    page = ("regexp_replace(regexp_replace(array_to_string(list_filter(string_split(p, chr(10)), "
            "lambda l: NOT regexp_matches(l, '^\\s*$')), chr(10)), '\\s\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')")
    return f"array_to_string(list_transform(string_split({x}, chr(12)), lambda p: {page}), chr(12))"


@register("clean_document", sql=f"""
WITH {VARIANT_SQL}
SELECT doc_id, length({_clean_sql('text')}) AS n_chars, md5({_clean_sql('text')}) AS text_md5 FROM _docs""")
def q_clean_document(t: Tables) -> DataFrame:
    """#29: blank lines dropped, whitespace squeezed, trimmed, per page."""
    c = clean_document("text")
    return variant_docs(t).select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("text_md5"))


# Small thresholds so the sf0.01 documents really get pre-split.
SMALL_OVER, SMALL_SECTION = 5000, 2000


@register("pre_split", sql=f"""
WITH s AS (
  SELECT doc_id, length(text) > {SMALL_OVER} AS split,
         CASE WHEN length(text) > {SMALL_OVER}
              THEN list_transform(range(0, CAST(ceil(length(text) / {float(SMALL_SECTION)}) AS BIGINT)),
                                  lambda i: substring(text, CAST(i * {SMALL_SECTION} + 1 AS BIGINT), {SMALL_SECTION}))
              ELSE [text] END AS secs
  FROM documents
),
x AS (SELECT doc_id, split, secs, unnest(range(0, len(secs))) AS i FROM s)
SELECT doc_id, CASE WHEN split THEN CAST(i AS BIGINT) END AS section_index,
       CASE WHEN split THEN CAST(len(secs) AS BIGINT) END AS section_total,
       CAST(length(secs[i + 1]) AS BIGINT) AS n_chars, md5(secs[i + 1]) AS text_md5
FROM x""")
def q_pre_split(t: Tables) -> DataFrame:
    """#25: long texts cut into fixed-size sections (strict > threshold)."""
    d = prepare.pre_split(t.documents.select("doc_id", "text"), "text", SMALL_OVER, SMALL_SECTION)
    return d.select("doc_id", F.col("section_index").cast("long").alias("section_index"),
                    F.col("section_total").cast("long").alias("section_total"),
                    F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("chunk_positions", sql=f"""
WITH {chunks_cte(over=SMALL_OVER, section=SMALL_SECTION)}
SELECT doc_id, CAST(section_index AS BIGINT) AS section_index, CAST(section_total AS BIGINT) AS section_total,
       chunk_index, total_chunks, md5(content) AS content_md5
FROM chunks""")
def q_chunk_positions(t: Tables) -> DataFrame:
    """#27: chunk_index/total_chunks numbered across all sections of a file."""
    c = prepare.prepare_chunks(t.documents, INGESTED_AT, over=SMALL_OVER, section=SMALL_SECTION)
    return c.select("doc_id", F.col("section_index").cast("long").alias("section_index"),
                    F.col("section_total").cast("long").alias("section_total"),
                    F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col("total_chunks").cast("long").alias("total_chunks"), F.md5("content").alias("content_md5"))


# Smaller windows on the form-feed variant so pages advance inside documents.
PAGE_SIZE, PAGE_OVERLAP = 60, 10


@register("page_numbers", sql=f"""
WITH {VARIANT_SQL}, {_on_variant(chunks_cte(size=PAGE_SIZE, overlap=PAGE_OVERLAP))}
SELECT doc_id, chunk_index, page_number FROM chunks""")
def q_page_numbers(t: Tables) -> DataFrame:
    """#28: page of a chunk = form feeds in earlier chunks' non-overlapping heads + 1."""
    c = prepare.prepare_chunks(variant_docs(t).withColumn("n_chars", F.length("text")), INGESTED_AT,
                               size=PAGE_SIZE, overlap=PAGE_OVERLAP)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col("page_number").cast("long").alias("page_number"))


@register("truncate_chunks", sql=f"""
WITH {chunks_cte()}
SELECT doc_id, chunk_index, CAST(length(substring(content, 1, 500)) AS BIGINT) AS n_chars,
       md5(substring(content, 1, 500)) AS head_md5
FROM chunks""")
def q_truncate_chunks(t: Tables) -> DataFrame:
    """#32: first 500 characters of each chunk for context."""
    head = prepare.truncate_chunks("content")
    return chunk_store(t).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                                 F.length(head).cast("long").alias("n_chars"), F.md5(head).alias("head_md5"))


_META_ID = "CASE WHEN chunk_index % 5 = 1 THEN 'c-' || CAST(doc_id AS STRING) || '-' || CAST(chunk_index AS STRING) END"
_DOC_ID = ("CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL "
           "ELSE 'd' || CAST(doc_id AS STRING) || '.' || CAST(chunk_index AS STRING) END")


@register("content_key", sql=f"""
WITH {chunks_cte()}
SELECT doc_id, chunk_index,
       coalesce({_META_ID.replace('AS STRING', 'AS VARCHAR')}, nullif({_DOC_ID.replace('AS STRING', 'AS VARCHAR')}, ''),
                coalesce(source_filename, 'unknown') || ':' || CAST(chunk_index AS VARCHAR)) AS chunk_id
FROM chunks""")
def q_content_key(t: Tables) -> DataFrame:
    """#34: meta chunk_id -> non-empty doc id -> filename:chunk_index."""
    c = chunk_store(t)
    key = prepare.content_key(F.expr(_META_ID), F.expr(_DOC_ID), F.col("source_filename"), F.col("chunk_index"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), key.alias("chunk_id"))


@register("store_schema", sql=f"""
WITH {chunks_cte()}
SELECT content, source_filename, '' AS source_room_id, '' AS source_sender, CAST(chunk_index AS INTEGER) AS chunk_index,
       CAST(total_chunks AS INTEGER) AS total_chunks, {sql_str(INGESTED_AT)} AS ingested_at,
       CAST(page_number AS INTEGER) AS page_number, CAST(NULL AS VARCHAR) AS section_title
FROM chunks""")
def q_store_schema(t: Tables) -> DataFrame:
    """#6: chunks conformed to the fixed store schema."""
    return store.conform(chunk_store(t))


@register("list_documents", sql=f"""
WITH {chunks_cte()}
SELECT coalesce(source_filename, 'unknown') AS filename,
       CAST(arg_min(total_chunks, chunk_index) AS BIGINT) AS chunk_count,
       arg_min(coalesce({sql_str(INGESTED_AT)}, 'unknown'), chunk_index) AS ingested_at
FROM chunks GROUP BY 1""")
def q_list_documents(t: Tables) -> DataFrame:
    """#43: inventory, one row per filename."""
    inv = retrieval.list_documents(chunk_store(t))
    return inv.select("filename", F.col("chunk_count").cast("long").alias("chunk_count"), "ingested_at")


# ------------------------------------------------ replace-by-filename (#5)

OLD_SIZE, OLD_OVERLAP = 300, 30
OLD_AT = "2023-06-01T00:00:00+00:00"


def old_store(t: Tables) -> DataFrame:
    """Previous ingest: documents with the old window size, plus page texts."""
    docs = prepare.prepare_chunks(t.documents, OLD_AT, size=OLD_SIZE, overlap=OLD_OVERLAP)
    pages = t.pages.select(F.col("page_id").alias("doc_id"), F.lit("pages").alias("source"),
                           html_to_text("html").alias("text"))
    page_chunks = prepare.prepare_chunks(pages, OLD_AT, size=OLD_SIZE, overlap=OLD_OVERLAP)
    page_chunks = page_chunks.withColumn("source_filename", F.regexp_replace("source_filename", r"\.txt$", ".html"))
    return docs.unionByName(page_chunks)


@register("replace_document", sql=f"""
WITH {chunks_cte()},
{chunks_cte_from('documents', 'od', 'old_docs', size=OLD_SIZE, overlap=OLD_OVERLAP)},
_pdocs AS (SELECT page_id AS doc_id, 'pages' AS source, {html_to_text_sql('html')} AS text FROM pages),
{chunks_cte_from('_pdocs', 'op', 'old_pages', size=OLD_SIZE, overlap=OLD_OVERLAP)},
old AS (
  SELECT source_filename, total_chunks, {sql_str(OLD_AT)} AS ingested_at FROM old_docs
  UNION ALL
  SELECT regexp_replace(source_filename, '\\.txt$', '.html'), total_chunks, {sql_str(OLD_AT)} FROM old_pages
),
merged AS (
  SELECT * FROM old WHERE source_filename NOT IN (SELECT source_filename FROM chunks)
  UNION ALL
  SELECT source_filename, total_chunks, {sql_str(INGESTED_AT)} FROM chunks
)
SELECT source_filename, ingested_at, count(*) AS n_chunks, CAST(max(total_chunks) AS BIGINT) AS total_chunks
FROM merged GROUP BY source_filename, ingested_at""")
def q_replace_document(t: Tables) -> DataFrame:
    """#5: re-ingest deletes a file's old chunks and writes its new ones."""
    new = chunk_store(t)
    merged = store.replace_by_filename(old_store(t), new)
    return (merged.groupBy("source_filename", "ingested_at")
            .agg(F.count(F.lit(1)).alias("n_chunks"), F.max("total_chunks").cast("long").alias("total_chunks")))


@register("ingest_summary", sql=f"""
WITH {chunks_cte()}, {chunks_cte_from('documents', 'o', 'old', size=OLD_SIZE, overlap=OLD_OVERLAP)},
d AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS source_filename,
             length({collapse_sql('text')}) AS n_chars
      FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, {BLANK_SQL})),
n AS (SELECT source_filename, count(*) AS chunks_stored, count(DISTINCT coalesce(section_index, -1)) AS sections
      FROM chunks GROUP BY 1),
o AS (SELECT source_filename, count(*) AS stale_deleted FROM old GROUP BY 1)
SELECT d.source_filename, CAST(d.n_chars AS BIGINT) AS n_chars, CAST(n.sections AS BIGINT) AS sections,
       CAST(n.chunks_stored AS BIGINT) AS chunks_stored, CAST(coalesce(o.stale_deleted, 0) AS BIGINT) AS stale_deleted,
       {sql_str(INGESTED_AT)} AS ingested_at
FROM d JOIN n USING (source_filename) LEFT JOIN o USING (source_filename)""")
def q_ingest_summary(t: Tables) -> DataFrame:
    """#57: per file chars, sections, chunks stored, stale chunks deleted."""
    kept, _ = prepare.drop_empty(t.documents)
    files = kept.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
                        .alias("source_filename"), F.length(collapse_whitespace("text")).alias("n_chars"))
    old = prepare.prepare_chunks(t.documents, OLD_AT, size=OLD_SIZE, overlap=OLD_OVERLAP)
    return store.ingest_summary(files, chunk_store(t), old, INGESTED_AT)


# ------------------------------------------------------ request handling

_REQ = {
    "top_k": "CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '3' WHEN 2 THEN 'true' WHEN 3 THEN '26' "
             "WHEN 4 THEN '0' ELSE 'abc' END",
    "mode": "CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'smart' WHEN 2 THEN ' RAW ' WHEN 3 THEN 'invalid' "
            "ELSE 'both' END",
    "response_mode": "CASE WHEN item_id % 3 = 0 THEN 'raw' END",
    "query": "CASE WHEN item_id % 9 = 4 THEN '   ' ELSE text END",
}


def requests(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), *[F.expr(e).alias(k) for k, e in _REQ.items()])


def _validate_sql() -> str:
    k_num = "TRY_CAST(trim(top_k) AS INTEGER)"
    is_bool = "lower(trim(top_k)) IN ('true', 'false')"
    k = (f"CASE WHEN top_k IS NULL THEN 5 WHEN {is_bool} OR {k_num} IS NULL THEN 5 "
         f"WHEN {k_num} < 1 OR {k_num} > 25 THEN 5 ELSE {k_num} END")
    k_err = (f"CASE WHEN top_k IS NULL THEN NULL WHEN {is_bool} THEN 'Invalid top_k type: expected integer, got bool' "
             f"WHEN {k_num} IS NULL THEN 'Invalid top_k: expected integer, got ''' || top_k || '''' "
             f"WHEN {k_num} < 1 OR {k_num} > 25 THEN 'Invalid top_k value: must be between 1 and 25' END")
    req = "coalesce(response_mode, mode)"
    norm = f"lower(trim({req}))"
    alias = f"CASE {norm} WHEN 'smart' THEN 'synthesis' WHEN 'synthesis' THEN 'synthesis' WHEN 'raw' THEN 'raw' WHEN 'both' THEN 'both' END"
    mode = f"CASE WHEN {req} IS NULL THEN 'synthesis' ELSE {alias} END"
    mode_err = f"CASE WHEN {req} IS NOT NULL AND ({alias}) IS NULL THEN 'Invalid response_mode: expected one of synthesis, raw, both' END"
    q_err = "CASE WHEN query IS NULL OR trim(query) = '' OR regexp_matches(query, '^\\s*$') THEN 'Empty query provided' END"
    cols = ", ".join(f"{e} AS {n}" for n, e in _REQ.items())
    return f"""
SELECT query_id, top_k, mode, response_mode, query, CAST({k} AS INTEGER) AS k, {mode} AS resolved_mode,
       coalesce({q_err}, {mode_err}, {k_err}) AS error
FROM (SELECT item_id AS query_id, {cols} FROM benchmark) r"""


@register("validate_request", sql=_validate_sql())
def q_validate_request(t: Tables) -> DataFrame:
    """#42: k and mode normalised, invalid requests become error rows."""
    return retrieval.validate_request(requests(t))


def filtered_bm25(t: Tables) -> DataFrame:
    """#10 + #41: per-query filename filter (before ranking) and per-query k."""
    q = query_table(t).join(
        t.documents.select(F.col("doc_id").alias("query_id"),
                           F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("_f")),
        "query_id", "left").select("query_id", "query", F.concat(F.col("_f"), F.lit(".txt")).alias("filename_filter"),
                                   (1 + F.col("query_id") % 7).alias("k"))
    scored = retrieval.bm25_search(search_index(t), q, KEYS, wanted_file="filename_filter")
    return retrieval.top_k(scored.join(q.select("query_id", "k"), "query_id"), "query_id", "bm25", KEYS, F.col("k"))


@register("batch_topk", sql=f"""
WITH {chunks_cte()},
_q AS (SELECT b.item_id AS query_id, b.text AS query, d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS filename_filter,
              1 + b.item_id % 7 AS k
       FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id),
{bm25_cte()},
f AS (SELECT b.*, q.k FROM bm25 b JOIN chunks c USING (doc_id, chunk_index) JOIN _q q USING (query_id)
      WHERE q.filename_filter IS NULL OR c.source_filename = q.filename_filter),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id, chunk_index) AS rank FROM f)
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, chunk_index, round(bm25, 4) AS score FROM r WHERE rank <= k""")
def q_batch_topk(t: Tables) -> DataFrame:
    """#10/#41: per-query filename filter and per-query k."""
    return filtered_bm25(t).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                                   F.col("chunk_index").cast("long").alias("chunk_index"),
                                   F.round("bm25", 4).alias("score"))


@register("filename_filter", sql=f"""
WITH {chunks_cte()},
_q AS (SELECT b.item_id AS query_id, b.text AS query,
              d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS filename_filter
       FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id),
{bm25_cte()}
SELECT b.query_id, b.doc_id, b.chunk_index, round(b.bm25, 4) AS score
FROM bm25 b JOIN chunks c USING (doc_id, chunk_index) JOIN _q q USING (query_id)
WHERE q.filename_filter IS NULL OR c.source_filename = q.filename_filter""")
def q_filename_filter(t: Tables) -> DataFrame:
    """#10: exact filename equality applied before ranking (every match kept)."""
    q = query_table(t).join(
        t.documents.select(F.col("doc_id").alias("query_id"),
                           F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
                           .alias("filename_filter")), "query_id", "left")
    kept = retrieval.bm25_search(search_index(t), q, KEYS, wanted_file="filename_filter")
    return kept.select("query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                       F.round("bm25", 4).alias("score"))
