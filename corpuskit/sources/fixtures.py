"""Inputs derived deterministically from the driver's tables.

Each derivation exists twice: as a Spark plan (used by the registered
queries) and as DuckDB SQL (used by the oracles). Where possible both are
generated from one expression text written in the SQL subset that Spark SQL
and DuckDB read the same way (``||``, ``split_part``, ``md5``, ``substr``,
``CAST(... AS STRING)``; no backslashes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.tables import Tables

# --------------------------------------------------------------- URL cases
# Owner-like name and ids from each page; every page yields every URL shape.
_OWNER = "split_part(replace(replace(split_part(url, '/', 3), 'm.', ''), 'blog.', ''), '.', 1)"
_P = "CAST(page_id AS STRING)"
_H = "md5(url)"
URL_FORMS: list[tuple[str, str]] = [
    ("page", "url"),
    ("repo_blob", f"'https://github.com/' || {_OWNER} || '/r' || {_P} || '/blob/main/docs/p' || {_P} || '.md'"),
    ("repo_bare", f"'github.com/' || {_OWNER} || '/r' || {_P}"),
    ("repo_tree_nopath", f"'https://github.com/' || {_OWNER} || '/r' || {_P} || '/tree/main'"),
    ("repo_www", f"'https://www.github.com/' || {_OWNER} || '/r' || {_P}"),
    ("raw", f"'https://raw.githubusercontent.com/' || {_OWNER} || '/r' || {_P} || '/main/src/f' || {_P} || '.py'"),
    ("raw_refs", f"'https://raw.githubusercontent.com/' || {_OWNER} || '/r' || {_P} || '/refs/heads/main/f.txt'"),
    ("raw_branch_only", f"'https://raw.githubusercontent.com/' || {_OWNER} || '/r' || {_P} || '/dev'"),
    ("issue", f"'https://github.com/' || {_OWNER} || '/r' || {_P} || '/issues/' || {_P} || '#issuecomment-1'"),
    ("pull", f"'https://m.github.com/' || {_OWNER} || '/r' || {_P} || '/pull/' || CAST(page_id + 1 AS STRING)"),
    ("question", f"'https://stackoverflow.com/questions/' || {_P} || '/how-to-' || {_OWNER}"),
    ("video", f"'https://www.youtube.com/watch?v=' || substr({_H}, 1, 11) || '&t=10'"),
    ("video_short", f"'https://youtu.be/' || substr({_H}, 12, 11)"),
    ("wiki", f"'https://www.notion.so/Team-' || {_H}"),
    ("wiki_dashed", f"'https://www.notion.so/' || upper(substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-' || "
                    f"substr({_H}, 13, 4) || '-' || substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12))"),
    ("doi", f"'https://doi.org/10.' || CAST(1000 + page_id AS STRING) || '/j.' || {_OWNER} || '.' || {_P} || '?via=x'"),
    ("doi_pdf", f"'https://files.example.org/pub/10.' || CAST(1000 + page_id AS STRING) || '/x' || {_P} || '.pdf'"),
    ("academic", f"'https://arxiv.org/abs/' || {_P}"),
    ("academic_pdf", f"'https://www.nature.com/articles/10.' || CAST(1000 + page_id % 100 AS STRING) || '/o' || {_P} || '.pdf'"),
]


def url_cases(t: Tables) -> DataFrame:
    """``page_id, kind, url`` for every page and every URL shape (one scan of
    ``pages``, the shapes dealt out with an explode)."""
    p = t.pages.select("page_id", "url")
    forms = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("url")) for k, e in URL_FORMS])
    return p.select("page_id", F.explode(forms).alias("f")).select("page_id", "f.kind", "f.url")


def url_cases_sql(name: str = "url_cases") -> str:
    parts = [f"SELECT page_id, '{k}' AS kind, {e.replace('AS STRING', 'AS VARCHAR')} AS url FROM pages"
             for k, e in URL_FORMS]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


# ------------------------------------------------------------ JSON items
# One bibliographic-style item per order; every fourth order is an attachment
# of the order before it. Lines of the order become a nested array.
_ITEM_TYPE = "CASE WHEN o_orderkey % 4 = 3 THEN 'attachment' ELSE 'journalArticle' END"
_ITEM_URL = "CASE WHEN o_orderkey % 3 = 0 THEN 'https://arxiv.org/abs/' || CAST(o_orderkey AS STRING) END"
_ITEM_DOI = "'10.' || CAST(1000 + o_orderkey % 100 AS STRING) || '/o' || CAST(o_orderkey AS STRING)"
_ITEM_PARENT = "CASE WHEN o_orderkey % 4 = 3 THEN 'I' || CAST(o_orderkey - 1 AS STRING) END"
_ITEM_FILE = ("CASE WHEN o_orderkey % 4 = 3 THEN 'file' || CAST(o_orderkey AS STRING) || "
              "CASE WHEN o_orderkey % 8 = 3 THEN '.pdf' ELSE '.html' END END")
ITEM_FIELDS: list[tuple[str, str]] = [
    ("key", "'I' || CAST(o_orderkey AS STRING)"),
    ("itemType", _ITEM_TYPE),
    ("title", "'Order ' || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority"),
    ("url", _ITEM_URL),
    ("DOI", _ITEM_DOI),
    ("status", "o_orderstatus"),
    ("priority", "CAST(substr(o_orderpriority, 1, 1) AS INT)"),
    ("total", "o_totalprice"),
    ("inLibrary", "o_orderkey % 2 = 0"),
    ("parentItem", _ITEM_PARENT),
    ("filename", _ITEM_FILE),
]


def items(t: Tables) -> DataFrame:
    """``item_key, version, date_modified, item_data`` (JSON text)."""
    lines = (t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("l_linenumber").alias("linenumber"), F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"), F.col("l_quantity").alias("quantity")))).alias("lines")))
    o = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    creators = F.array(
        F.struct(F.concat(F.lit("F"), (F.col("o_custkey") % 7).cast("string")).alias("firstName"),
                 F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("lastName"),
                 F.lit("author").alias("creatorType")),
        F.struct(F.lit("Ed").alias("firstName"),
                 F.concat(F.lit("C"), (F.col("o_orderkey") % 50).cast("string")).alias("lastName"),
                 F.lit("editor").alias("creatorType")))
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    data = F.struct(*[F.expr(e).alias(k) for k, e in ITEM_FIELDS],
                    date.alias("dateModified"), creators.alias("creators"),
                    F.coalesce(F.col("lines"), F.array().cast(lines.schema["lines"].dataType)).alias("lines"))
    return o.select(
        F.concat(F.lit("I"), F.col("o_orderkey").cast("string")).alias("item_key"),
        (F.col("o_orderkey") % 5).cast("long").alias("version"),
        date.alias("date_modified"),
        F.to_json(F.struct(F.concat(F.lit("I"), F.col("o_orderkey").cast("string")).alias("key"),
                           (F.col("o_orderkey") % 5).alias("version"), data.alias("data"))).alias("item_data"))


def items_sql(name: str = "items") -> str:
    fields = ", ".join(f"'{k}', {e.replace('AS STRING', 'AS VARCHAR')}" for k, e in ITEM_FIELDS)
    return f"""_lines AS (
  SELECT l_orderkey, list(json_object('linenumber', l_linenumber, 'returnflag', l_returnflag,
                                      'linestatus', l_linestatus, 'quantity', l_quantity)
                          ORDER BY l_linenumber) AS lines
  FROM lineitem GROUP BY l_orderkey
),
{name} AS (
  SELECT 'I' || CAST(o_orderkey AS VARCHAR) AS item_key, CAST(o_orderkey % 5 AS BIGINT) AS version,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date_modified,
         CAST(json_object('key', 'I' || CAST(o_orderkey AS VARCHAR), 'version', o_orderkey % 5,
           'data', json_object({fields},
             'dateModified', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'),
             'creators', [json_object('firstName', 'F' || CAST(o_custkey % 7 AS VARCHAR),
                                      'lastName', 'C' || CAST(o_custkey % 50 AS VARCHAR), 'creatorType', 'author'),
                          json_object('firstName', 'Ed', 'lastName', 'C' || CAST(o_orderkey % 50 AS VARCHAR),
                                      'creatorType', 'editor')],
             'lines', coalesce(_lines.lines, []))) AS VARCHAR) AS item_data
  FROM orders LEFT JOIN _lines ON l_orderkey = o_orderkey
)"""
