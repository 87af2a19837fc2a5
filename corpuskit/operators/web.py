"""Web-result operators: fusion, page-text join, source mix, exact dedupe,
time / facet filters, paging (#14-16, #49-50, #60, #71, #74)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import BLANK_RE

# --- fixed values ------------------------------------------------------------
UNTITLED = "Untitled"
TIME_RANGES = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "year": "1 YEAR"}
# -----------------------------------------------------------------------------


def hit_id(url: Column, content: Column, provider: Column, rank: Column) -> Column:
    """Document id of a hit: same URL and same text = same document. A hit
    without text is a document of its own (by provider and rank)."""
    own = F.concat(F.lit("\u0002"), provider, F.lit(":"), rank.cast("string"))
    return F.sha2(F.concat(F.coalesce(url, F.lit("\u0002")), F.lit("\u0001"), F.coalesce(content, own)), 256)


def fuse_sources(hits: DataFrame, provider_order: dict[str, int], qid: str = "query_id") -> DataFrame:
    """#71: union of providers, one row per (query, document id) with its best
    score; rows ordered by score desc, unscored last (``pos``).

    Both windows are bounded by a query's hit list (providers x results).
    """
    pidx = F.create_map(*[F.lit(x) for kv in provider_order.items() for x in kv])[F.col("provider")]
    h = hits.withColumn("hit_id", hit_id(F.col("url"), F.col("content"), F.col("provider"), F.col("rank"))).withColumn("_p", pidx)
    order = [F.col("score").desc_nulls_last(), F.col("_p"), F.col("rank")]
    best = (h.withColumn("_rn", F.row_number().over(Window.partitionBy(qid, "hit_id").orderBy(*order)))
             .filter("_rn = 1"))
    return best.withColumn("pos", F.row_number().over(Window.partitionBy(qid).orderBy(*order))).drop("_rn", "_p")


def hit_url(hits: DataFrame) -> Column:
    """URL of a hit: the ``url`` value when present (even if empty), else ``link``."""
    link = F.col("meta").getItem("link") if "meta" in hits.columns else F.lit(None).cast("string")
    has_url = F.col("url").isNotNull()
    if "meta" in hits.columns:
        has_url = has_url | F.map_contains_key(F.col("meta"), F.lit("url"))
    return F.when(has_url, F.col("url")).otherwise(link)


def extract_urls(hits: DataFrame) -> DataFrame:
    """#50: link list of hits, one row per hit (``url`` wins over ``link``)."""
    return hits.withColumn("url", hit_url(hits))


def usable_pages(pages: DataFrame, url: str = "url", text: str = "text", seq: str = "page_id") -> DataFrame:
    """Pages with a URL and non-blank text; for a repeated URL the last page wins."""
    # The text condition sits inside the aggregate (max_by ignores rows whose
    # ordering value is null): as a filter, Catalyst would push it below the
    # projection and evaluate the (expensive) text expression twice.
    ok = F.col(text).isNotNull() & ~F.col(text).rlike(BLANK_RE)
    with_url = pages.filter(F.col(url).isNotNull() & (F.col(url) != ""))
    return (with_url.groupBy(url)
            .agg(F.max_by(F.when(ok, F.col(text)), F.when(ok, F.col(seq))).alias("page_text"))
            .filter(F.col("page_text").isNotNull()))


def usable_urls(pages: DataFrame, url: str = "url", text: str = "text", seq: str = "page_id") -> DataFrame:
    """The URLs of ``usable_pages``, with ``usable`` = true: no text is shuffled."""
    ok = F.coalesce(~F.col(text).rlike(BLANK_RE), F.lit(False)) & F.col(seq).isNotNull()
    with_url = pages.filter(F.col(url).isNotNull() & (F.col(url) != ""))
    return with_url.groupBy(url).agg(F.bool_or(ok).alias("usable")).filter("usable")


def join_content(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """#49: left join hits to page text by URL; hit text is the fallback."""
    h = hits.withColumn("url", hit_url(hits)).filter(F.col("url").isNotNull() & (F.col("url") != ""))
    j = h.join(usable_pages(pages), "url", "left")
    return (j.withColumn("title", F.coalesce(F.col("title"), F.lit(UNTITLED)))
             .withColumn("replaced", F.col("page_text").isNotNull())
             .withColumn("content", F.coalesce(F.col("page_text"), F.col("content")))
             .drop("page_text"))


def source_mix(raw: DataFrame, kept: DataFrame, pages: DataFrame, provider: str = "provider") -> DataFrame:
    """#60: per provider results, kept, dropped and replaced-by-page-text counts."""
    a = raw.groupBy(provider).agg(F.count(F.lit(1)).alias("n_raw"))
    k = (kept.join(usable_urls(pages), "url", "left").groupBy(provider)
         .agg(F.count(F.lit(1)).alias("n_kept"), F.count("usable").alias("n_replaced")))
    return a.join(k, provider).select(provider, "n_raw", "n_kept", (F.col("n_raw") - F.col("n_kept")).alias("n_dropped"),
                                      "n_replaced")


def normalised_key(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def exact_dedupe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """#74 exact: one row per normalised text, smallest id kept (partial aggregate,
    so a text repeated a billion times is still combined map-side)."""
    return (df.filter(F.col(text_col).isNotNull())
              .groupBy(normalised_key(F.col(text_col)).alias("text_key"))
              .agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_copies")))


def in_time_range(ts: Column, time_range: str | None, as_of: str) -> Column:
    """True when ``ts`` lies within day/week/month/year before ``as_of``."""
    if not time_range:
        return F.lit(True)
    start = F.expr(f"timestamp'{as_of}' - INTERVAL {TIME_RANGES[time_range]}")
    return (ts >= start) & (ts <= F.lit(as_of).cast("timestamp"))


def time_range_filter(df: DataFrame, ts: str, time_range: str | None, as_of: str) -> DataFrame:
    """#14: rows within day/week/month/year before ``as_of`` ('' / None = off)."""
    return df if not time_range else df.filter(in_time_range(F.col(ts), time_range, as_of))


def page_results(df: DataFrame, order: list[str], size: int, page: int) -> DataFrame:
    """#16: page ``page`` (1-based) of ``size`` rows in ``order``; ``pos`` is
    the 1-based overall position. Planned as a top-(offset+size) sort."""
    off = size * (page - 1)
    rows = df.orderBy(*order).offset(off).limit(size)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)) + off)


def page_after(df: DataFrame, key: str, token, size: int) -> DataFrame:
    """Keyset paging for large tables: rows with ``key > token``; the next
    token is the last key of the page."""
    q = df if token is None else df.filter(F.col(key) > F.lit(token))
    return q.orderBy(key).limit(size)


def facet_filter(df: DataFrame, languages: list[str] | None = None, categories: list[str] | None = None,
                 engines: list[str] | None = None, safesearch: int = 0, lang: str = "lang",
                 category_col: str = "source", engine_col: str | None = None, toxic: str = "toxic") -> DataFrame:
    """#15: language, categories / engines (any of), safesearch 0/1/2.

    safesearch 0 keeps all, 1 drops rows labelled toxic, 2 keeps only rows
    labelled non-toxic (0 is a real level, not 'unset').
    """
    cond = F.lit(True)
    if languages:
        cond = cond & F.col(lang).isin(languages)
    if categories:
        cond = cond & F.arrays_overlap(F.array(F.col(category_col)), F.array(*[F.lit(c) for c in categories]))
    if engines and engine_col:
        cond = cond & F.arrays_overlap(F.array(F.col(engine_col)), F.array(*[F.lit(e) for e in engines]))
    if safesearch == 1:
        cond = cond & (F.coalesce(F.col(toxic), F.lit(0)) == 0)
    elif safesearch == 2:
        cond = cond & (F.col(toxic) == 0)
    return df.filter(cond)
