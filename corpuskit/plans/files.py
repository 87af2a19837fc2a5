"""File corpus queries (#1, #73): documents and pages as files of mixed type.

The registered queries feed ``convert_files`` with ``binaryFile``-shaped rows
derived from the tables (path, content); ``read_corpus`` runs the same
conversion behind a real ``binaryFile`` scan (see tests/test_files.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.plans.corpus import _clean_sql
from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import html_to_text_sql, sql_str
from corpuskit.plans.urls import _conv_sql, _mime_sql
from corpuskit.sources import files as FS
from corpuskit.tables import Tables

DOC_PATH = ("'corpus/docs/' || source || '/' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.txt' "
            "WHEN 1 THEN '.md' WHEN 2 THEN '.mdx' WHEN 3 THEN '.csv' WHEN 4 THEN '.pdf' ELSE '.dat' END")
DOC_BODY = ("CASE doc_id % 6 "
            "WHEN 1 THEN '# ' || source || chr(10) || chr(10) || '**' || lang || '** [link](http://x/' "
            "|| CAST(doc_id AS STRING) || ') ' || text "
            "WHEN 2 THEN '## Notes' || chr(10) || text || ' `code` ![img](a.png)' "
            "WHEN 3 THEN 'id,text' || chr(10) || CAST(doc_id AS STRING) || ',\"' || replace(text, '\"', '\"\"') || '\"' "
            "ELSE text END")
PAGE_PATH = "'corpus/pages/' || CAST(page_id AS STRING) || '.html'"


def doc_files(t: Tables) -> DataFrame:
    return t.documents.select(F.expr(DOC_PATH).alias("path"), F.encode(F.expr(DOC_BODY), "UTF-8").alias("content"))


def page_files(t: Tables) -> DataFrame:
    return t.pages.select(F.expr(PAGE_PATH).alias("path"), F.encode("html", "UTF-8").alias("content"))


def _md_sql(x: str) -> str:
    for pat, rep in FS.MD_RULES:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(rep.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def _convert_sql(src: str) -> str:
    return f"""SELECT path, mime, conv AS converter,
       CASE WHEN t IS NOT NULL THEN {_clean_sql('t')} END AS text
FROM (SELECT path, mime, conv,
             CASE conv WHEN 'html' THEN {html_to_text_sql('raw')} WHEN 'markdown' THEN {_md_sql('raw')}
                       WHEN 'pdf' THEN NULL ELSE raw END AS t
      FROM (SELECT path, raw, mime, {_conv_sql('mime')} AS conv
            FROM (SELECT path, raw, {_mime_sql('path')} AS mime FROM {src})))"""


FILES_SQL = f"""_f AS (
  SELECT {DOC_PATH.replace('AS STRING', 'AS VARCHAR')} AS path, {DOC_BODY.replace('AS STRING', 'AS VARCHAR')} AS raw
  FROM documents
  UNION ALL SELECT {PAGE_PATH.replace('AS STRING', 'AS VARCHAR')}, html FROM pages
),
_conv AS ({_convert_sql('_f')})"""


@register("read_corpus", sql=f"""
WITH {FILES_SQL}
SELECT path, mime, converter, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM _conv""")
def q_read_corpus(t: Tables) -> DataFrame:
    """#1: files of mixed type -> cleaned text by MIME converter (pdf -> null)."""
    docs = FS.convert_files(doc_files(t).unionByName(page_files(t)))
    return docs.select("path", "mime", "converter", F.length("text").cast("long").alias("n_chars"),
                       F.md5("text").alias("text_md5"))


@register("union_converted", sql=f"""
WITH {FILES_SQL}
SELECT converter, count(*) AS n_files, count(text) AS n_with_text FROM _conv GROUP BY converter""")
def q_union_converted(t: Tables) -> DataFrame:
    """#73: bag union of the converted document files and page files."""
    u = FS.union_converted(FS.convert_files(doc_files(t)), FS.convert_files(page_files(t)))
    return u.groupBy("converter").agg(F.count(F.lit(1)).alias("n_files"), F.count("text").alias("n_with_text"))
