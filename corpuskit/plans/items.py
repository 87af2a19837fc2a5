"""JSON item queries: predicates, upsert, hydrate, children, URL/DOI lookup,
academic match, intersect, incremental sync (#4, #19-20, #51-52, #54, #56,
#72, #99 batch twin). Items are built from ``orders`` + ``lineitem``.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import jsonq
from corpuskit.functions import urls as U
from corpuskit.functions.mime import mime_of
from corpuskit.operators import index as IX
from corpuskit.operators import items as I
from corpuskit.operators import itemstore as IS
from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import group_sql, held_cte, sql_str
from corpuskit.session import checkpoint_dir
from corpuskit.sources import fixtures as X
from corpuskit.tables import Tables

ITEMS = X.items_sql()

# --- fixed values: predicate queries exercised over every item -----------
FIELD_QUERIES: dict[str, Any] = {
    "eq_status": {"status": "F"},
    "two_keys": {"status": "O", "priority": 1},
    "text_vs_number": {"priority": "1"},
    "ne_type": {"itemType": {"$ne": "attachment"}},
    "exists_url": {"url": {"$exists": True}},
    "top_level_p": [{"parentItem": {"$exists": False}}, {"status": "P"}],
    "ne_wins": {"url": {"$ne": "x", "$exists": False}},
    "bad_exists": {"url": {"$exists": "yes"}},
    "unknown_op": {"title": {"$gt": 5}},
    "empty_obj": {},
    "empty_list": [],
    "not_a_dict": ["status"],
    "null_value": {"url": None},
    "true_eq": {"inLibrary": True},
    "false_is_zero": {"inLibrary": 0},
    "one_is_true": {"priority": True},
    "ne_true": {"inLibrary": {"$ne": 1}},
}
ARRAY_QUERIES: dict[str, Any] = {
    "creator_last": {"creators.lastName": "C7"},
    "creator_ne": {"creators.creatorType": {"$ne": "author"}},
    "line_flag_and": [{"lines.returnflag": "R"}, {"status": "F"}],
    "line_missing_prop": {"lines.nosuch": {"$exists": False}},
    "deep_path_two_parts": {"creators.lastName.extra": "C7"},
}
# -----------------------------------------------------------------------------


# ------------------------------------------------------ DuckDB compiler

def _leaf_sql(j: str, op: str, value: Any) -> str:
    present = f"({j} IS NOT NULL AND json_type({j}) <> 'NULL')"
    if op == "exists":
        return present if value else f"NOT coalesce({present}, false)"
    if value is None:
        return "false"
    if isinstance(value, (int, float)):
        same = f"json_type({j}) IN ('BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE', 'INTEGER')"
        got = (f"CASE json_extract_string({j}, '$') WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 "
               f"ELSE TRY_CAST(json_extract_string({j}, '$') AS DOUBLE) END")
        lit = repr(float(value))
    else:
        same = f"json_type({j}) = 'VARCHAR'"
        got = f"json_extract_string({j}, '$')"
        lit = sql_str(value)
    if op == "eq":
        return f"coalesce({present} AND {same} AND ({got}) = {lit}, false)"
    return f"coalesce({present} AND (NOT ({same}) OR ({got}) <> {lit}), false)"


def _cond_sql(field: str, op: str, value: Any, doc: str = "item_data") -> str:
    if "." in field:
        parts = field.split(".")
        arr, prop = parts[0], parts[1]
        path = arr if arr.startswith("data.") else f"data.{arr}"
        elems = f"CAST(json_extract({doc}, '$.{path}[*]') AS JSON[])"
        leaf = _leaf_sql(f"json_extract(x, '$.{prop}')", op, value)
        return f"coalesce(len(list_filter({elems}, lambda x: {leaf})) > 0, false)"
    return _leaf_sql(f"json_extract({doc}, '$.data.{field}')", op, value)


def query_sql(query: Any, doc: str = "item_data") -> str:
    conds = jsonq.conditions(query)
    if conds is None:
        return "false"
    return "(" + " AND ".join(_cond_sql(f, o, v, doc) for f, o, v in conds) + ")"


def _matches(t: Tables, queries: dict[str, Any]) -> DataFrame:
    """One scan: every item against every query, exploded to matches."""
    documents = X.items(t).select("item_key", F.parse_json("item_data").alias("doc"))
    return IS.ItemStore(documents, ()).find_each(queries)


def _matches_sql(queries: dict[str, Any]) -> str:
    parts = [f"SELECT '{n}' AS query_name, item_key FROM items WHERE {query_sql(q)}" for n, q in queries.items()]
    return f"WITH {ITEMS}\n" + "\nUNION ALL ".join(parts)


@register("json_find", sql=_matches_sql(FIELD_QUERIES))
def q_json_find(t: Tables) -> DataFrame:
    """#19: document-style predicates on item fields."""
    return _matches(t, FIELD_QUERIES)


@register("json_array_find", sql=_matches_sql(ARRAY_QUERIES))
def q_json_array_find(t: Tables) -> DataFrame:
    """#20: dotted paths = any element of a nested array matches."""
    return _matches(t, ARRAY_QUERIES)


INTERSECT_QUERY = [{"itemType": {"$ne": "attachment"}}, {"creators.lastName": "C3"}, {"status": "O"}]


@register("intersect_predicates", sql=f"WITH {ITEMS}\n" + "\nINTERSECT ".join(
    f"SELECT item_key FROM items WHERE {query_sql({f: ({'$ne': v} if o == 'ne' else v)})}"
    for f, o, v in jsonq.conditions(INTERSECT_QUERY)))
def q_intersect_predicates(t: Tables) -> DataFrame:
    """#72: AND of conditions as INTERSECT of key sets (Catalyst: semi joins)."""
    return I.intersect_keys(X.items(t), INTERSECT_QUERY)


HYDRATE_QUERY = {"creators.lastName": "C11"}


@register("hydrate_keys", sql=f"""
WITH {ITEMS}
SELECT i.item_key, i.version, i.date_modified, json_extract_string(i.item_data, '$.data.title') AS title
FROM items i WHERE i.item_key IN (SELECT item_key FROM items WHERE {query_sql(HYDRATE_QUERY)})""")
def q_hydrate_keys(t: Tables) -> DataFrame:
    """#54: keys found by a predicate -> full items (semi join)."""
    it = X.items(t)
    keys = it.filter(jsonq.compile_query(F.parse_json("item_data"), HYDRATE_QUERY)).select("item_key")
    full = I.hydrate(it, keys)
    return full.select("item_key", "version", "date_modified",
                       F.get_json_object("item_data", "$.data.title").alias("title"))


# ------------------------------------------------------------- upsert

def new_versions(t: Tables) -> DataFrame:
    """Second batch: every open order re-issued with version + 5."""
    it = X.items(t)
    return (it.filter(F.get_json_object("item_data", "$.data.status") == "O")
              .withColumn("version", F.col("version") + 5)
              .withColumn("item_data", F.regexp_replace("item_data", '"title":"Order ', '"title":"Revised ')))


@register("upsert_items", sql=f"""
WITH {ITEMS},
n AS (SELECT item_key, version + 5 AS version, replace(json_extract_string(item_data, '$.data.title'), 'Order ', 'Revised ') AS title
      FROM items WHERE json_extract_string(item_data, '$.data.status') = 'O'),
o AS (SELECT item_key, version, json_extract_string(item_data, '$.data.title') AS title FROM items),
u AS (SELECT * FROM o UNION ALL SELECT * FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY version DESC) AS rn FROM u)
SELECT item_key, version, title FROM r WHERE rn = 1""")
def q_upsert_items(t: Tables) -> DataFrame:
    """#4: insert-or-replace by key, last (highest version) write wins."""
    up = I.upsert(X.items(t), new_versions(t))
    return up.select("item_key", "version", F.get_json_object("item_data", "$.data.title").alias("title"))


SYNC_POS = 3


@register("sync_batch", sql=f"""
WITH {ITEMS},
full_load AS (SELECT item_key, version FROM items WHERE json_extract_string(item_data, '$.data.parentItem') IS NULL),
delta AS (SELECT item_key, version FROM items WHERE version > {SYNC_POS}),
u AS (SELECT * FROM full_load UNION ALL SELECT * FROM delta),
r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY version DESC) AS rn FROM u)
SELECT item_key, version FROM r WHERE rn = 1""")
def q_sync_batch(t: Tables) -> DataFrame:
    """#99 batch twin: full load of top-level items at position 0, then the
    items with version > position upserted on top."""
    it = X.items(t)
    state = I.sync_step(None, it, 0)
    state = I.sync_step(state, it, SYNC_POS)
    return state.select("item_key", "version")


# ----------------------------------------------------- children, lookups

@register("attach_children", sql=f"""
WITH {ITEMS},
p AS (SELECT item_key FROM items WHERE coalesce(json_extract_string(item_data, '$.data.itemType'), '') <> 'attachment'),
c AS (SELECT item_key AS child_key, json_extract_string(item_data, '$.data.parentItem') AS parent_key,
             json_extract_string(item_data, '$.data.filename') AS filename
      FROM items WHERE json_extract_string(item_data, '$.data.itemType') = 'attachment'
        AND json_extract_string(item_data, '$.data.filename') IS NOT NULL)
SELECT p.item_key AS parent_key, c.child_key, c.filename,
       CASE WHEN c.child_key IS NULL THEN NULL
            WHEN lower(regexp_extract(c.filename, '\\.([A-Za-z0-9]+)$', 1)) = 'pdf' THEN 'application/pdf'
            WHEN lower(regexp_extract(c.filename, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm') THEN 'text/html'
            ELSE 'application/octet-stream' END AS mime_type
FROM p LEFT JOIN c ON c.parent_key = p.item_key""")
def q_attach_children(t: Tables) -> DataFrame:
    """#51: parents with their attachment children (mime from filename);
    parents without any keep one row with null child."""
    out = I.attach_children(X.items(t))
    return out.select("parent_key", "child_key", "filename",
                      F.when(F.col("child_key").isNotNull(), mime_of(F.col("filename"))).alias("mime_type"))


LOOKUP_URL = ("CASE WHEN o_orderkey % 2 = 0 THEN 'https://arxiv.org/abs/' || CAST(o_orderkey AS STRING) "
              "ELSE 'https://doi.org/10.' || CAST(1000 + o_orderkey % 100 AS STRING) || '/o' || CAST(o_orderkey AS STRING) END")


LOOKUP_SQL = f"""
WITH {ITEMS},
u AS (SELECT {LOOKUP_URL.replace('AS STRING', 'AS VARCHAR')} AS url FROM orders),
top AS (SELECT item_key, json_extract_string(item_data, '$.data.url') AS iurl,
               json_extract_string(item_data, '$.data.DOI') AS doi
        FROM items WHERE coalesce(json_extract_string(item_data, '$.data.itemType'), '') <> 'attachment'
          AND json_extract_string(item_data, '$.data.parentItem') IS NULL),
m AS (
  SELECT u.url, t.item_key, 1 AS prio FROM u JOIN top t ON t.iurl = u.url
  UNION ALL
  SELECT u.url, t.item_key, 2 FROM u JOIN top t
    ON t.doi = coalesce({group_sql('u.url', U.DOI_URL_RE, 1)}, {group_sql('u.url', U.DOI_PDF_RE, 1)})
),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY prio, item_key) AS rn FROM m)
SELECT url, item_key, CASE prio WHEN 1 THEN 'url' ELSE 'doi' END AS matched_by FROM r WHERE rn = 1"""


@register("lookup_url_then_doi", sql=LOOKUP_SQL)
def q_lookup_url_then_doi(t: Tables) -> DataFrame:
    """#52: exact URL match first, else DOI match; top-level non-attachments."""
    urls = t.orders.select(F.expr(LOOKUP_URL).alias("url"))
    return I.lookup_url_then_doi(urls, X.items(t)).select("url", "item_key", "matched_by")


# ------------------------------------------------------- stored items

#: (application, folder of the tables, versions of their sources) -> folder of the written items
_STORES: dict[tuple, str] = {}


def item_store(t: Tables) -> IS.ItemStore:
    """The stored items: written by the session's first search, and again when the
    files of the tables that they come from have changed."""
    folder = t.sf_dir.rstrip("/")
    name = (t.spark.conf.get("spark.app.id"), folder,
            *[IX.source_version(t.spark, f"{folder}/{table}.parquet") for table in ("orders", "lineitem")])
    if name not in _STORES:
        path = f"{checkpoint_dir(t.spark).rstrip('/')}/items-{uuid.uuid4().hex}"
        IS.write_items(X.items(t), path)
        _STORES[name] = path
    return IS.open_items(t.spark, _STORES[name])


@register("item_store_find", sql=_matches_sql({**FIELD_QUERIES, **ARRAY_QUERIES}))
def q_item_store_find(t: Tables) -> DataFrame:
    """#19/#20 over stored items: hot paths from their columns, others from the VARIANT."""
    return item_store(t).find_each({**FIELD_QUERIES, **ARRAY_QUERIES})


@register("item_store_lookup", sql=LOOKUP_SQL)
def q_item_store_lookup(t: Tables) -> DataFrame:
    """#52 over stored items: exact URL first, else DOI, from the paths' columns."""
    store = item_store(t)
    urls = t.orders.select(F.expr(LOOKUP_URL).alias("url"))
    return I.lookup_url_then_doi(urls, store.rows, field=store.text).select("url", "item_key", "matched_by")


@register("academic_match", sql=f"""
WITH {X.url_cases_sql()}, {ITEMS}, {held_cte('url_cases')}
SELECT c.page_id, c.kind, c.url, h.url IS NOT NULL AS held FROM url_cases c LEFT JOIN _held h USING (url)
WHERE {' OR '.join(f"contains(c.url, {sql_str(d)})" for d in U.ACADEMIC_DOMAINS)}""")
def q_academic_match(t: Tables) -> DataFrame:
    """#56: URLs on academic hosts, and whether the library holds them (by URL or DOI)."""
    cases = X.url_cases(t).filter(U.is_academic("url"))
    return I.held(cases, X.items(t)).select("page_id", "kind", "url", "held")

