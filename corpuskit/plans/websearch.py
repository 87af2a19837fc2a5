"""Multi-source search with page text (entry point C) and related filters:
#3, #12, #14-17, #30-31, #49-50, #60-62, #71, #74.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import html_title, html_to_text
from corpuskit.operators import results, web
from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import NORM_SQL, html_to_text_sql, sql_str
from corpuskit.sources import hits as H
from corpuskit.session import checkpoint_dir
from corpuskit.tables import Tables

TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
PROVIDER_ORDER = {p: i for i, p in enumerate(H.PROVIDERS)}


def hits(t: Tables, n: int = 5) -> DataFrame:
    return H.normalize_hits(H.provider_responses(t), max_results=n)


def written_texts(t: Tables) -> DataFrame:
    """The page texts in a new folder under the shared one, for queries that read them several times."""
    texts = H.page_texts(t)
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/page-texts-{uuid.uuid4().hex}"
    texts.write.parquet(path)
    return t.spark.read.schema(texts.schema).parquet(path)


# DuckDB: the same hits restated directly from pages (no JSON round trip).
_BASE = f"""
_pt AS (SELECT page_id, url, regexp_extract(html, {sql_str(TITLE_RE)}, 1) AS title, {html_to_text_sql('html')} AS text
        FROM pages),
_r AS (SELECT _pt.*, greatest(CAST(ceil(length(text) / {H.RESULTS}.0) AS BIGINT), 1) AS step,
              unnest(range(0, {H.RESULTS})) AS r FROM _pt),
_s AS (SELECT *, substring(text, 1 + r * step, step) AS piece FROM _r),
_f AS (
  SELECT page_id AS query_id, page_id, CAST(r AS BIGINT) AS rank, piece, title || ' #' || CAST(r AS VARCHAR) AS title,
         CASE WHEN r = 0 THEN url
              WHEN r % 3 = 1 THEN (CASE WHEN page_id % 4 = 1 THEN '' ELSE url || '#alt' || CAST(r AS VARCHAR) END)
              WHEN r % 3 = 2 THEN 'https://mirror.example.org/p/' || CAST(page_id AS VARCHAR) || '/' || CAST(r AS VARCHAR)
              ELSE url || '#part' || CAST(r AS VARCHAR) END AS url,
         CASE WHEN r % 3 = 2 AND page_id % 5 = 0 THEN '' ELSE piece END AS content
  FROM _s
)"""


def hits_sql(n: int = 5, name: str = "hits", raw: bool = False, base: bool = True) -> str:
    """``name(query_id, provider, rank, title, url, content, score, meta_text)``.

    ``raw``: no first-N slice and no required-field drop.
    """
    slice_ = "" if raw or n <= 0 else f"AND rank < {n}"
    req = "" if raw else "AND url IS NOT NULL AND url <> '' AND content IS NOT NULL AND content <> ''"
    meta_s = ("'category=general;engine=e' || CAST(page_id % 3 AS VARCHAR) || "
              "CASE WHEN page_id % 2 = 0 THEN ';language=en' ELSE '' END || "
              f"';score=' || CAST(({H.RESULTS} - rank) * 1.5 AS VARCHAR) || ';title=' || title || ';url=' || url")
    meta_tu = "'title=' || title || ';url=' || url"
    exa_text = "CASE WHEN page_id % 3 = 0 THEN NULL ELSE content END"
    exa_content = (f"CASE WHEN ({exa_text}) IS NULL OR ({exa_text}) = '' THEN 'Summary: ' || piece "
                   f"ELSE ({exa_text}) END")
    return f"""{_BASE + ',' if base else ''}
{name} AS (
  SELECT query_id, 'searxng' AS provider, rank, title, url, content, CAST(NULL AS DOUBLE) AS score, {meta_s} AS meta_text
  FROM _f WHERE true {slice_} {req}
  UNION ALL
  SELECT query_id, 'brave', rank, title, url, content, CAST(NULL AS DOUBLE), {meta_tu} FROM _f WHERE true {slice_} {req}
  UNION ALL
  SELECT query_id, 'exa', rank, title, url, {exa_content}, round(1.0 / (1 + rank + page_id % 7), 4), {meta_tu} FROM _f
  UNION ALL
  SELECT query_id, 'linkup', rank, title, url, content, round(1 - 0.1 * rank, 10), {meta_tu} FROM _f
  UNION ALL
  SELECT query_id, 'tavily', rank, title, url, content, round(0.95 - 0.05 * rank - (page_id % 5) * 0.01, 4), {meta_tu}
  FROM _f
)"""


_HIT_COLS = ["query_id", "provider", "rank", "title", "url", "content", "score"]


@register("normalize_hits", sql=f"WITH {hits_sql()} SELECT * FROM hits")
def q_normalize_hits(t: Tables) -> DataFrame:
    """#3 (+#12, #17, #61, #62): provider JSON -> common hit rows."""
    return hits(t).select(*_HIT_COLS, H.meta_text(F.col("meta")).alias("meta_text"))


@register("first_n_per_source", sql=f"""
WITH {hits_sql(raw=True)}
SELECT query_id, provider, rank, url FROM hits WHERE rank < 2""")
def q_first_n(t: Tables) -> DataFrame:
    """#61: first N=2 results of every response, before any other rule."""
    raw = H.raw_results(H.provider_responses(t))
    return H.first_n(raw, 2).select("query_id", "provider", "rank", "url")


@register("required_fields", sql=f"""
WITH {hits_sql(n=2)}
SELECT query_id, provider, rank, url FROM hits WHERE provider IN ('searxng', 'brave')""")
def q_required_fields(t: Tables) -> DataFrame:
    """#12: after the first-N slice, results lacking url or content are dropped."""
    return (hits(t, n=2).filter(F.col("provider").isin("searxng", "brave"))
            .select("query_id", "provider", "rank", "url"))


@register("rank_to_score", sql=f"""
WITH {hits_sql()}
SELECT query_id, rank, score FROM hits WHERE provider = 'linkup'""")
def q_rank_to_score(t: Tables) -> DataFrame:
    """#62: providers without scores get 1 - 0.1 * index."""
    return hits(t).filter(F.col("provider") == "linkup").select("query_id", "rank", "score")


@register("prune_null_meta", sql=f"""
WITH {hits_sql()}
SELECT query_id, rank, meta_text FROM hits WHERE provider = 'searxng'""")
def q_prune_null_meta(t: Tables) -> DataFrame:
    """#17: null-valued meta keys removed."""
    return (hits(t).filter(F.col("provider") == "searxng")
            .select("query_id", "rank", H.meta_text(F.col("meta")).alias("meta_text")))


_PIDX = "CASE provider " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(H.PROVIDERS)) + " END"


@register("fuse_sources", sql=f"""
WITH {hits_sql()},
k AS (SELECT *, sha256(coalesce(url, chr(2)) || chr(1) || coalesce(content, chr(2) || provider || ':' || rank)) AS hit_id, {_PIDX} AS pidx FROM hits),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, hit_id ORDER BY score DESC NULLS LAST, pidx, rank) AS rn FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, pidx, rank) AS pos
      FROM b WHERE rn = 1)
SELECT query_id, CAST(pos AS BIGINT) AS pos, hit_id, provider, rank, score FROM f""")
def q_fuse_sources(t: Tables) -> DataFrame:
    """#71: bag union of providers, one row per document id (best score), by score."""
    f = web.fuse_sources(hits(t), PROVIDER_ORDER)
    return f.select("query_id", F.col("pos").cast("long").alias("pos"), "hit_id", "provider", "rank", "score")


_PAGES_SQL = f"""
_pg AS (SELECT url, {html_to_text_sql('html')} AS ptext, page_id FROM pages
        WHERE url IS NOT NULL AND url <> ''),
_pages AS (SELECT url, arg_max(ptext, page_id) AS ptext FROM _pg
           WHERE ptext IS NOT NULL AND NOT regexp_matches(ptext, '^\\s*$') GROUP BY url)"""


@register("join_content", sql=f"""
WITH {hits_sql()}, {_PAGES_SQL}
SELECT h.query_id, h.provider, h.rank, coalesce(h.title, 'Untitled') AS title, h.url, h.score,
       coalesce(p.ptext, h.content) AS content, p.ptext IS NOT NULL AS replaced
FROM hits h LEFT JOIN _pages p USING (url)
WHERE h.url IS NOT NULL AND h.url <> ''""")
def q_join_content(t: Tables) -> DataFrame:
    """#49: hits get the full page text by URL, hit snippet as fallback."""
    pages = t.pages.select("page_id", "url", html_to_text("html").alias("text"))
    j = web.join_content(hits(t), pages)
    return j.select("query_id", "provider", "rank", "title", "url", "score", "content", "replaced")


def _page_block_sql(content: str, score: str = "") -> str:
    sc = f" || '<score>' || coalesce(CAST({score} AS VARCHAR), 'None') || '</score>' || chr(10)" if score else ""
    return (f"'<document>' || chr(10) || '<title>' || coalesce(title, '') || '</title>' || chr(10){sc} || '<url>' || coalesce(url, '') "
            f"|| '</url>' || chr(10) || '<content> ' || chr(10) || coalesce({content}, '') || chr(10) || '</content>' || chr(10) || '</document>'")


@register("context_web", sql=f"""
WITH {hits_sql()},
k AS (SELECT *, sha256(coalesce(url, chr(2)) || chr(1) || coalesce(content, chr(2) || provider || ':' || rank)) AS hit_id, {_PIDX} AS pidx FROM hits),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, hit_id ORDER BY score DESC NULLS LAST, pidx, rank) AS rn FROM k)
SELECT query_id, md5(string_agg({_page_block_sql('content', 'CAST(score AS DOUBLE)')}, chr(10) || chr(10)
                                ORDER BY score DESC NULLS LAST, pidx, rank)) AS context_md5, count(*) AS n_blocks
FROM b WHERE rn = 1 GROUP BY query_id""")
def q_context_web(t: Tables) -> DataFrame:
    """#47: per query the fused hits as context blocks, best first."""
    f = web.fuse_sources(hits(t), PROVIDER_ORDER)
    c = results.context_block(f, "query_id", "pos", results.page_block(F.col("title"), F.col("url"), F.col("content"), F.col("score")))
    return c.select("query_id", F.md5("context").alias("context_md5"), "n_blocks")


@register("context_pages", sql=f"""
WITH p AS (SELECT page_id, url, regexp_extract(html, {sql_str(TITLE_RE)}, 1) AS title, {html_to_text_sql('html')} AS text FROM pages)
SELECT page_id // 4 AS request_id, md5(string_agg({_page_block_sql('text')}, chr(10) || chr(10) ORDER BY page_id)) AS context_md5,
       count(*) AS n_blocks
FROM p GROUP BY page_id // 4""")
def q_context_pages(t: Tables) -> DataFrame:
    """#47: context blocks of the pages that a request asks for (four consecutive pages each)."""
    p = H.page_texts(t).withColumn("request_id", F.expr("page_id div 4"))
    c = results.context_block(p, "request_id", "page_id", results.page_block(F.col("title"), F.col("url"), F.col("text")))
    return c.select("request_id", F.md5("context").alias("context_md5"), "n_blocks")


@register("extract_urls", sql=f"""
WITH {hits_sql()}
SELECT query_id, provider, rank, url FROM hits""")
def q_extract_urls(t: Tables) -> DataFrame:
    """#50: link list of hits (``url`` wins over ``link``)."""
    return web.extract_urls(hits(t)).select("query_id", "provider", "rank", "url")


@register("source_mix", sql=f"""
WITH {hits_sql(raw=True, name='raw')}, {hits_sql(base=False)}, {_PAGES_SQL},
a AS (SELECT provider, count(*) AS n_raw FROM raw GROUP BY provider),
k AS (SELECT provider, count(*) AS n_kept, count(p.ptext) AS n_replaced FROM hits LEFT JOIN _pages p USING (url)
      GROUP BY provider)
SELECT provider, n_raw, n_kept, n_raw - n_kept AS n_dropped, n_replaced FROM a JOIN k USING (provider)""")
def q_source_mix(t: Tables) -> DataFrame:
    """#60: per provider: results, kept, dropped, replaced by full page text."""
    texts = written_texts(t)
    responses = H.provider_responses(t, texts)
    return web.source_mix(H.raw_results(responses), H.normalize_hits(responses), texts.select("page_id", "url", "text"))


@register("html_to_text", sql=f"""
SELECT page_id, CAST(length({html_to_text_sql('html')}) AS BIGINT) AS n_chars, md5({html_to_text_sql('html')}) AS text_md5
FROM pages""")
def q_html_to_text(t: Tables) -> DataFrame:
    """#30: page HTML -> readable text."""
    x = html_to_text("html")
    return t.pages.select("page_id", F.length(x).cast("long").alias("n_chars"), F.md5(x).alias("text_md5"))


@register("html_title", sql=f"SELECT page_id, regexp_extract(html, {sql_str(TITLE_RE)}, 1) AS title FROM pages")
def q_html_title(t: Tables) -> DataFrame:
    """#31: first <title> of each page."""
    return t.pages.select("page_id", html_title("html").alias("title"))


@register("dedupe_snippets", sql=f"""
SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_copies, sha256({NORM_SQL}) AS text_key
FROM documents WHERE text IS NOT NULL GROUP BY sha256({NORM_SQL})""")
def q_dedupe_snippets(t: Tables) -> DataFrame:
    """#74 (exact part): one row per normalised text, first document kept."""
    return web.exact_dedupe(t.documents, "doc_id", "text")


# --------------------------------------------------------------- filters

AS_OF = "2024-01-15 00:00:00"
RANGES = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "year": "1 YEAR"}


@register("time_range_filter", sql=" UNION ALL ".join(
    f"SELECT '{k}' AS time_range, event_id FROM events "
    f"WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {v} AND ts <= TIMESTAMP '{AS_OF}'" for k, v in RANGES.items()))
def q_time_range_filter(t: Tables) -> DataFrame:
    """#14: events inside day/week/month/year before a fixed as-of time."""
    ev = t.events
    hits = F.array(*[F.when(web.in_time_range(F.col("ts"), k, AS_OF), F.lit(k)) for k in RANGES])
    return (ev.select("event_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("time_range"))
              .select("time_range", "event_id"))


PAGE_SIZE, PAGE_NO = 50, 3


@register("page_results", sql=f"""
SELECT event_id, ts, CAST(row_number() OVER (ORDER BY ts, event_id) + {PAGE_SIZE * (PAGE_NO - 1)} AS BIGINT) AS pos
FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE * (PAGE_NO - 1)})""")
def q_page_results(t: Tables) -> DataFrame:
    """#16: page 3 of 50 by (ts, event_id) (the limit is the feature)."""
    return web.page_results(t.events, ["ts", "event_id"], PAGE_SIZE, PAGE_NO).select(
        "event_id", "ts", F.col("pos").cast("long").alias("pos"))


_LANGS = ["en", "de"]
_CATS = ["src1", "src3", "src5", "src7"]


@register("facet_filter", sql=" UNION ALL ".join(f"""
SELECT {lvl} AS safesearch, d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.lang IN ('en', 'de') AND d.source IN ('src1', 'src3', 'src5', 'src7')
  AND {('true' if lvl == 0 else 'coalesce(l.toxic, 0) = 0' if lvl == 1 else 'l.toxic = 0')}""" for lvl in (0, 1, 2)))
def q_facet_filter(t: Tables) -> DataFrame:
    """#15: language, categories (any of) and safesearch 0/1/2 on labels.toxic."""
    d = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    out = None
    for lvl in (0, 1, 2):
        part = web.facet_filter(d, languages=_LANGS, categories=_CATS, safesearch=lvl).select(
            F.lit(lvl).alias("safesearch"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out

