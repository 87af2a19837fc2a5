"""JSON item operators: upsert, incremental sync, hydrate, children,
URL-then-DOI lookup, held check, INTERSECT form of AND (#4, #51-52, #54, #56,
#72, #99)."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import jsonq
from corpuskit.functions.urls import extract_doi


def _data(field: str):
    return F.get_json_object("item_data", f"$.data.{field}")


def upsert(old: DataFrame, new: DataFrame, key: str = "item_key", version: str = "version") -> DataFrame:
    """#4: insert-or-replace by key; highest version wins, the new batch wins ties.

    ``max_by`` over (version, batch) is a partial aggregate: a key with very
    many versions is combined map-side instead of forming one window group.
    """
    cols = [c for c in old.columns]
    u = old.withColumn("_src", F.lit(0)).unionByName(new.select(*cols).withColumn("_src", F.lit(1)))
    best = F.max_by(F.struct(*[F.col(c) for c in cols if c != key]), F.struct(F.col(version), F.col("_src")))
    return u.groupBy(key).agg(best.alias("_b")).select(key, "_b.*").select(*cols)


def top_level(items: DataFrame) -> DataFrame:
    return items.filter(_data("parentItem").isNull())


def sync_step(state: DataFrame | None, items: DataFrame, position: int) -> DataFrame:
    """#99 batch form: position 0 = full load of top-level items; otherwise
    the items with version > position are upserted onto the state."""
    batch = top_level(items) if position == 0 else items.filter(F.col("version") > position)
    return batch if state is None else upsert(state, batch)


def hydrate(items: DataFrame, keys: DataFrame, key: str = "item_key") -> DataFrame:
    """#54: full items for a key set (semi join; keys may repeat)."""
    return items.join(keys, key, "left_semi")


def intersect_keys(items: DataFrame, query: Any, key: str = "item_key") -> DataFrame:
    """#72: AND of conditions as INTERSECT of per-condition key sets: the distinct keys
    that meet every condition, in any of their rows.

    The items are made, parsed and read once for all conditions; of a key only one
    flag per condition is shuffled.
    """
    parsed = items.withColumn("_v", F.parse_json("item_data"))
    met = [F.coalesce(c, F.lit(False)) for c in jsonq.condition_columns(F.col("_v"), query)]
    if not met:
        return items.select(key).limit(0)
    names = [f"_c{i}" for i in range(len(met))]
    flags = parsed.select(key, *[c.alias(n) for c, n in zip(met, names)]).filter(reduce(lambda x, y: x | y, map(F.col, names)))
    return flags.groupBy(key).agg(*[F.bool_or(n).alias(n) for n in names]).filter(
        reduce(lambda x, y: x & y, map(F.col, names))).select(key)


def attach_children(items: DataFrame) -> DataFrame:
    """#51: non-attachment parents x their attachment children with a filename."""
    parents = items.filter(F.coalesce(_data("itemType"), F.lit("")) != "attachment").select(
        F.col("item_key").alias("parent_key"))
    children = items.filter((_data("itemType") == "attachment") & _data("filename").isNotNull()
                            & F.col("item_key").isNotNull()).select(
        F.col("item_key").alias("child_key"), _data("parentItem").alias("parent_key"),
        _data("filename").alias("filename"))
    return parents.join(children, "parent_key", "left")


def lookup_url_then_doi(urls: DataFrame, items: DataFrame, url: str = "url", field=_data) -> DataFrame:
    """#52: per URL the first top-level non-attachment item by exact URL, else
    by DOI (ties: smallest item_key). ``field``: column of a path of an item.

    Both kinds of key are joined at once, so the items are parsed and shuffled
    once. ``min`` over a struct is a partial aggregate, so a URL repeated many
    times never forms one big group.
    """
    def keyed(df: DataFrame, first: str, by_url, by_doi) -> DataFrame:
        pair = F.array(F.struct(F.lit(1).alias("prio"), by_url.alias("_k")), F.struct(F.lit(2).alias("prio"), by_doi.alias("_k")))
        return df.select(first, F.inline(pair)).filter(F.col("_k").isNotNull())

    top = items.filter(field("parentItem").isNull() & (F.coalesce(field("itemType"), F.lit("")) != "attachment"))
    have = keyed(top, "item_key", field("url"), field("DOI"))
    want = keyed(urls.select(url), url, F.col(url), extract_doi(F.col(url)))
    best = want.join(have, ["prio", "_k"]).groupBy(url).agg(F.min(F.struct("prio", "item_key")).alias("_b"))
    return best.select(url, F.col("_b.item_key").alias("item_key"),
                       F.when(F.col("_b.prio") == 1, F.lit("url")).otherwise(F.lit("doi")).alias("matched_by"))


def held_urls(urls: DataFrame, items: DataFrame, url: str = "url") -> DataFrame:
    """The distinct URLs that the library holds, with ``held`` = true: a
    top-level item other than an attachment has the URL or its DOI."""
    return lookup_url_then_doi(urls.select(url).distinct(), items, url).select(url, F.lit(True).alias("held"))


def held(urls: DataFrame, items: DataFrame, url: str = "url") -> DataFrame:
    """#56: flag every row whose URL the library holds (by URL or DOI)."""
    return urls.join(held_urls(urls, items, url), url, "left").withColumn("held", F.coalesce("held", F.lit(False)))
