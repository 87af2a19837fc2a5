"""Search-provider responses -> one common hit table (#3, #12, #17, #61, #62).

Provider JSON arrives as text (one response per row). Each provider has its
own schema; ``normalize_hits`` parses them with explicit schemas
(``from_json``), explodes results with their position, applies the
provider's rules, and unions everything by name.

Per-provider rules (kept from the reference):
* metasearch: first N (N <= 0 = all), then drop results lacking url or
  content ('' counts as missing); score kept only in meta, so the hit has
  no score; meta keys with null values removed.
* brave: content = description, first N then the same drop; no score.
* exa: content = text, else summary; score given.
* linkup: score = 1 - 0.1 * index (negative from the twelfth result on).
* tavily: content and score given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import html_title, html_to_text
from corpuskit.tables import Tables

# --- fixed values ------------------------------------------------------------
PROVIDERS = ["searxng", "brave", "exa", "linkup", "tavily"]
SEARXNG_META_KEYS = ["title", "url", "category", "engine", "score", "language", "img_src",
                     "publishedDate", "thumbnail", "template"]
LINKUP_STEP = 0.1
# -----------------------------------------------------------------------------


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


# One superset schema: every provider's result fields, so all responses are
# parsed in a single pass (no per-provider scan and union).
_R = ("struct<title:string,url:string,content:string,description:string,text:string,summary:string,"
      "name:string,score:double,category:string,engine:string,language:string,img_src:string,"
      "publishedDate:string,thumbnail:string,template:string>")
UNION_SCHEMA = f"struct<results:array<{_R}>,web:struct<results:array<{_R}>>>"


def _exploded(responses: DataFrame, query_col: str, provider_col: str, body_col: str) -> DataFrame:
    j = F.from_json(body_col, UNION_SCHEMA)
    arr = F.when(F.col(provider_col) == "brave", j["web"]["results"]).otherwise(j["results"])
    # posexplode_outer: avoids an inferred size() filter that would re-parse the JSON
    x = responses.select(query_col, provider_col, F.posexplode_outer(arr).alias("rank", "h"))
    return x.filter(F.col("h").isNotNull())


def normalize_hits(responses: DataFrame, max_results: int = 5, query_col: str = "query_id",
                   provider_col: str = "provider", body_col: str = "body") -> DataFrame:
    """``query_id, provider, rank, title, url, content, score, meta`` (map<string,string>)."""
    x = _exploded(responses, query_col, provider_col, body_col)
    p = F.col(provider_col)
    h = lambda f: F.col(f"h.{f}")
    title = F.when(p == "linkup", h("name")).otherwise(h("title"))
    content = (F.when(p == "brave", h("description"))
                .when(p == "exa", F.when(_missing(h("text")), h("summary")).otherwise(h("text")))
                .otherwise(h("content")))
    score = (F.when(p.isin("searxng", "brave"), F.lit(None).cast("double"))
              .when(p == "linkup", rank_to_score(F.col("rank")))
              .otherwise(h("score")))
    full_meta = F.create_map(*[z for k in SEARXNG_META_KEYS for z in (F.lit(k), h(k).cast("string"))])
    short_meta = F.create_map(F.lit("title"), title, F.lit("url"), h("url"))
    meta = prune_null_meta(F.when(p == "searxng", full_meta).otherwise(short_meta))
    sliced = p.isin("searxng", "brave")
    keep = ~sliced | ((F.lit(max_results <= 0) | (F.col("rank") < max_results))
                      & ~_missing(h("url")) & ~_missing(content))
    return (x.filter(keep)
             .select(query_col, provider_col, F.col("rank").cast("long").alias("rank"), title.alias("title"),
                     h("url").alias("url"), content.alias("content"), score.alias("score"), meta.alias("meta")))


def first_n(df: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """#61: first N results per response (N <= 0 keeps all)."""
    return df if n <= 0 else df.filter(F.col(rank) < n)


def rank_to_score(rank: Column) -> Column:
    """#62: 1 - 0.1 * index, rounded to kill float noise."""
    return F.round(F.lit(1.0) - F.lit(LINKUP_STEP) * rank, 10)


def prune_null_meta(m: Column) -> Column:
    """#17: drop map entries whose value is null."""
    return F.map_filter(m, lambda k, v: v.isNotNull())


def meta_text(m: Column) -> Column:
    """Map as ``k=v;k=v`` in key order (for display and comparison)."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


# ------------------------------------------------------------ derivation
# One response per (page, provider). Its results carry the whole page text
# between them, dealt out in order. The first has the page's URL, the others
# alternate (missing for some pages), mirror (without a snippet for some
# pages) and section URLs.
RESULTS = 12


def page_texts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", html_title("html").alias("title"),
                          html_to_text("html").alias("text"))


def _pieces() -> Column:
    """The results of a page: ``r, title, url, piece, content``."""
    pid = F.col("page_id")
    step = F.greatest(F.ceil(F.length("text") / RESULTS), F.lit(1)).cast("int")

    def one(r):
        n = r.cast("string")
        url = (F.when(r == 0, F.col("url"))
                .when(r % 3 == 1, F.when(pid % 4 == 1, F.lit("")).otherwise(F.concat("url", F.lit("#alt"), n)))
                .when(r % 3 == 2, F.concat(F.lit("https://mirror.example.org/p/"), pid.cast("string"), F.lit("/"), n))
                .otherwise(F.concat("url", F.lit("#part"), n)))
        piece = F.substring(F.col("text"), 1 + r * step, step)
        return F.struct(r.alias("r"), F.concat("title", F.lit(" #"), n).alias("title"), url.alias("url"),
                        piece.alias("piece"),
                        F.when((r % 3 == 2) & (pid % 5 == 0), F.lit("")).otherwise(piece).alias("content"))
    return F.transform(F.sequence(F.lit(0), F.lit(RESULTS - 1)), one)


def _body(p: str) -> Column:
    """JSON response of provider ``p`` made from ``pieces``."""
    pid = F.col("page_id")

    def one(x):
        title, url, content = x["title"].alias("title"), x["url"].alias("url"), x["content"]
        if p == "searxng":
            return F.struct(title, url, content.alias("content"), F.lit("general").alias("category"),
                            F.concat(F.lit("e"), (pid % 3).cast("string")).alias("engine"),
                            ((RESULTS - x["r"]) * 1.5).alias("score"),
                            F.when(pid % 2 == 0, F.lit("en")).alias("language"))
        if p == "brave":
            return F.struct(title, url, content.alias("description"))
        if p == "exa":
            return F.struct(title, url, F.when(pid % 3 != 0, content).alias("text"),
                            F.concat(F.lit("Summary: "), x["piece"]).alias("summary"),
                            F.round(F.lit(1.0) / (1 + x["r"] + pid % 7), 4).alias("score"))
        if p == "linkup":
            return F.struct(x["title"].alias("name"), url, content.alias("content"))
        return F.struct(title, url, content.alias("content"),
                        F.round(0.95 - 0.05 * x["r"] - (pid % 5) * 0.01, 4).alias("score"))
    arr = F.transform("pieces", one)
    body = F.struct(F.struct(arr.alias("results")).alias("web")) if p == "brave" else F.struct(arr.alias("results"))
    return F.to_json(body)


def provider_responses(t: Tables, texts: DataFrame | None = None) -> DataFrame:
    """``query_id (= page_id), provider, body`` for every page and provider
    (page text is derived once per page, then dealt to the five providers).
    ``texts``: the rows of ``page_texts``, where they are written already."""
    pt = (page_texts(t) if texts is None else texts).select("page_id", _pieces().alias("pieces"))
    per = F.array(*[F.struct(F.lit(p).alias("provider"), _body(p).alias("body")) for p in PROVIDERS])
    return (pt.select(F.col("page_id").alias("query_id"), F.explode(per).alias("r"))
              .select("query_id", "r.provider", "r.body"))


def raw_results(responses: DataFrame, query_col: str = "query_id", provider_col: str = "provider",
                body_col: str = "body") -> DataFrame:
    """Every result of every response, before any provider rule:
    ``query_id, provider, rank, url``."""
    x = _exploded(responses, query_col, provider_col, body_col)
    return x.select(query_col, provider_col, F.col("rank").cast("long").alias("rank"), F.col("h.url").alias("url"))
