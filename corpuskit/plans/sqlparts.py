"""DuckDB SQL fragments shared by the oracle queries.

They restate the Spark operators' definitions in SQL so that each oracle is a
standalone statement over the raw tables (no Spark output is reused).
"""

from __future__ import annotations

from corpuskit.functions import urls as U
from corpuskit.functions.text import STOP_WORDS, TOKEN_SPLIT
from corpuskit.operators.prepare import (
    CHUNK_OVERLAP, CHUNK_WORDS, PRESPLIT_OVER, PRESPLIT_SECTION,
)
from corpuskit.operators.retrieval import BM25_B, BM25_K1

INGESTED_AT = "2024-01-01T00:00:00+00:00"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


STOP_SQL = sql_list(STOP_WORDS)


def tokens_sql(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({expr}), '{TOKEN_SPLIT}'), "
            f"lambda t: t <> '' AND NOT list_contains({STOP_SQL}, t))")


#: DuckDB twin of the normal form that exact copies share.
NORM_SQL = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"

BLANK_SQL = r"'^[ \t\n\r\f\x0B]*$'"


def collapse_sql(expr: str) -> str:
    return (f"regexp_replace(regexp_replace({expr}, '\\n{{3,}}', chr(10) || chr(10), 'g'), "
            f"'[ \\t]{{2,}}', ' ', 'g')")


def nchunks_sql(nw: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> str:
    step = size - overlap
    return f"(CASE WHEN {nw} <= {size} THEN 1 ELSE CAST(ceil(({nw} - {size}) / {float(step)}) AS BIGINT) + 1 END)"


def chunks_cte(size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
               over: int = PRESPLIT_OVER, section: int = PRESPLIT_SECTION,
               name: str = "chunks") -> str:
    """CTEs ending in ``<name>(doc_id, source_filename, chunk_index, total_chunks,
    page_number, section_index, section_total, content)``."""
    step = size - overlap
    return f"""
_kept AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS source_filename,
         {collapse_sql('text')} AS text
  FROM documents
  WHERE text IS NOT NULL AND NOT regexp_matches(text, {BLANK_SQL})
),
_sec0 AS (
  SELECT doc_id, source_filename, length(text) > {over} AS is_split,
         CASE WHEN length(text) > {over}
              THEN list_transform(range(0, CAST(ceil(length(text) / {float(section)}) AS BIGINT)),
                                  lambda i: substring(text, CAST(i * {section} + 1 AS BIGINT), {section}))
              ELSE [text] END AS sections
  FROM _kept
),
_sec1 AS (
  SELECT *, list_transform(sections, lambda s: {nchunks_sql("len(string_split(s, ' '))", size, overlap)}) AS counts
  FROM _sec0
),
_sec2 AS (
  SELECT doc_id, source_filename, is_split, len(sections) AS n_sec, list_sum(counts) AS total_chunks,
         counts, sections, unnest(range(0, len(sections))) AS spos
  FROM _sec1
),
_sec AS (
  SELECT doc_id, source_filename, total_chunks,
         CASE WHEN is_split THEN spos END AS section_index,
         CASE WHEN is_split THEN n_sec END AS section_total,
         coalesce(list_sum(list_slice(counts, 1, spos)), 0) AS off,
         sections[spos + 1] AS s, string_split(sections[spos + 1], ' ') AS w
  FROM _sec2
),
_ch0 AS (
  SELECT *, len(w) AS nw, unnest(range(0, {nchunks_sql('len(w)', size, overlap)})) AS k FROM _sec
),
{name} AS (
  SELECT doc_id, source_filename, CAST(off + k AS BIGINT) AS chunk_index, CAST(total_chunks AS BIGINT) AS total_chunks,
         CAST(CASE WHEN contains(s, chr(12))
              THEN 1 + coalesce(list_sum(list_transform(list_slice(w, 1, k * {step}),
                                   lambda x: length(x) - length(replace(x, chr(12), '')))), 0)
              ELSE 1 END AS BIGINT) AS page_number,
         section_index, section_total,
         array_to_string(list_slice(w, k * {step} + 1, k * {step} + {size}), ' ')
           || CASE WHEN k * {step} + {size} < nw THEN ' ' ELSE '' END AS content
  FROM _ch0
)"""


def bm25_cte(chunks: str = "chunks", queries: str = "_q", name: str = "bm25",
             k1: float = BM25_K1, b: float = BM25_B) -> str:
    """``<name>(query_id, doc_id, chunk_index, bm25)``; ``queries`` has (query_id, query)."""
    return f"""
_toks AS (SELECT doc_id, chunk_index, {tokens_sql('content')} AS t FROM {chunks}),
_stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM _toks),
_post AS (
  SELECT doc_id, chunk_index, dl, term, count(*) AS tf
  FROM (SELECT doc_id, chunk_index, len(t) AS dl, unnest(t) AS term FROM _toks)
  GROUP BY doc_id, chunk_index, dl, term
),
_qt AS (SELECT DISTINCT query_id, unnest(list_distinct({tokens_sql('query')})) AS term FROM {queries}),
_df AS (SELECT term, count(*) AS df FROM _post WHERE term IN (SELECT term FROM _qt) GROUP BY term),
{name} AS (
  SELECT _qt.query_id, p.doc_id, p.chunk_index,
         sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5))
             * p.tf * {k1 + 1} / (p.tf + {k1} * (1 - {b} + {b} * p.dl / s.avgdl))) AS bm25
  FROM _post p JOIN _qt USING (term) JOIN _df d USING (term) CROSS JOIN _stats s
  GROUP BY _qt.query_id, p.doc_id, p.chunk_index
)"""


def group_sql(u: str, pat: str, i: int) -> str:
    """DuckDB twin of ``functions.urls._group``: group i, null when no match."""
    return f"(CASE WHEN regexp_matches({u}, {sql_str(pat)}) THEN regexp_extract({u}, {sql_str(pat)}, {i}) END)"


def held_cte(src: str, name: str = "_held") -> str:
    """``<name>(url, held)``: the URLs of ``src`` that a top-level item other than
    an attachment has as its URL or DOI (needs the CTE ``items``)."""
    doi = f"coalesce({group_sql('url', U.DOI_URL_RE, 1)}, {group_sql('url', U.DOI_PDF_RE, 1)})"
    return f"""_top AS (
  SELECT json_extract_string(item_data, '$.data.url') AS iurl, json_extract_string(item_data, '$.data.DOI') AS idoi
  FROM items WHERE coalesce(json_extract_string(item_data, '$.data.itemType'), '') <> 'attachment'
    AND json_extract_string(item_data, '$.data.parentItem') IS NULL
),
{name} AS (SELECT DISTINCT url, true AS held FROM {src}
  WHERE url IN (SELECT iurl FROM _top) OR {doi} IN (SELECT idoi FROM _top))"""


def rx(u: str, pat: str) -> str:
    return f"regexp_matches({u}, {sql_str(pat)})"


def chunks_cte_from(src: str, prefix: str, name: str, **kw) -> str:
    """``chunks_cte`` reading ``src`` (doc_id, source, text) with private CTE names."""
    text = chunks_cte(name=name, **kw)
    for n in ("_kept", "_sec", "_ch0"):
        text = text.replace(n, f"_{prefix}{n}")
    return text.replace("FROM documents", f"FROM {src}")


def html_to_text_sql(x: str) -> str:
    """DuckDB twin of ``functions.text.html_to_text``."""
    from corpuskit.functions import text as T
    e = f"regexp_replace({x}, {sql_str(T._COMMENTS)}, '', 'g')"
    for tag in T.DROP_TAGS:
        e = f"regexp_replace({e}, {sql_str(rf'(?is)<{tag}\b[^>]*>.*?</{tag}\s*>')}, '', 'g')"
    e = f"regexp_replace({e}, {sql_str(T._BLOCK_TAGS)}, chr(10), 'g')"
    e = f"regexp_replace({e}, {sql_str(T._TAGS)}, '', 'g')"
    for ent, ch in T.ENTITIES:
        e = f"replace({e}, {sql_str(ent)}, {sql_str(ch)})"
    e = f"regexp_replace({e}, '[ \\t]+', ' ', 'g')"
    e = f"regexp_replace({e}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
