"""Stored items: JSON parsed once, frequent paths as typed columns (#19, #20, #52, #54, #72).

A written item has its key, version and date, the whole document as VARIANT, and
for every hot path under ``data`` three columns: the kind of the value (``S``
text, ``N`` number or boolean, ``O`` other; null for a missing or null value), the
text, and the number (true and false as 1 and 0). A predicate on a hot path is
then a plain comparison that Parquet can evaluate (pushed down to row groups,
with bloom filters on the texts of the paths in ``keyed``), and a scan reads
that path's columns only. Other paths, and paths into arrays, are read from the
VARIANT with the same rules (``functions.jsonq``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import jsonq

HOT = ("itemType", "status", "title", "url", "DOI", "parentItem", "priority")
KEYED = ("url", "DOI", "parentItem")


@dataclass(frozen=True)
class ItemStore:
    """``rows``: item_key, version, date_modified, doc, the columns of the ``hot`` paths, and the ``arrays`` read."""

    rows: DataFrame
    hot: tuple[str, ...]
    arrays: tuple[str, ...] = ()

    def text(self, field: str) -> Column:
        """The text at a path (null for other kinds)."""
        return F.col(f"{field}_s") if field in self.hot else F.try_variant_get("doc", f"$.data.{field}", "string")

    def _condition(self, field: str, op: str, value: Any) -> Column:
        if field.split(".")[0] in self.arrays and "." in field:
            return jsonq._cond(F.col("doc"), field, op, value, F.col(f"{field.split('.')[0]}_e"))
        if field not in self.hot:
            return jsonq._cond(F.col("doc"), field, op, value)
        kind, text, number = (F.col(f"{field}_{c}") for c in "ksn")
        if op == "exists":
            return kind.isNotNull() if value else kind.isNull()
        if value is None:
            return F.lit(False)
        own, col, lit = ("N", number, float(value)) if isinstance(value, (int, float)) else ("S", text, value)
        # equality alone, so that it can be pushed down; a null never passes a filter
        return col == F.lit(lit) if op == "eq" else kind.isNotNull() & ((kind != own) | (col != F.lit(lit)))

    def condition(self, query: Any) -> Column:
        """The predicate of a document-style query (to filter with: null counts as false)."""
        conditions = jsonq.conditions(query)
        if conditions is None:
            return F.lit(False)
        out = F.lit(True)
        for field, op, value in conditions:
            out = out & self._condition(field, op, value)
        return out

    def find(self, query: Any) -> DataFrame:
        """The items that match a query."""
        return self.rows.filter(self.condition(query))

    def find_each(self, queries: dict[str, Any]) -> DataFrame:
        """(query_name, item_key) of many queries, in one scan; a path or an array that
        several of them ask for is read from the document once."""
        asked = {f: None for q in queries.values() for f, _, _ in jsonq.conditions(q) or []}
        more = tuple(f for f in asked if "." not in f and f not in self.hot)
        arrays = tuple({f.split(".")[0]: None for f in asked if "." in f})
        rows = typed(self.rows, more).select("*", *[jsonq.elements(F.col("doc"), f).alias(f"{f}_e") for f in arrays])
        read = ItemStore(rows, (*self.hot, *more), arrays)
        hits = F.array(*[F.when(read.condition(q), F.lit(n)) for n, q in queries.items()])
        # the conditions in a projection of their own, which Spark compiles; inside a generator
        # or below a lambda function they would be interpreted. The outer form infers no filter on the array.
        met = rows.select("item_key", (hits if queries else F.array().cast("array<string>")).alias("_hits"))
        return met.select("item_key", F.explode_outer("_hits").alias("query_name")).filter("query_name IS NOT NULL").select(
            "query_name", "item_key")


def typed(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows with a VARIANT ``doc``, and kind, text and number at each path.

    A path is read, and the type of its value found, once a row: each step
    uses the columns of the one before it.
    """
    read = documents.select("*", *[F.try_variant_get("doc", f"$.data.{f}", "variant").alias(f"_{f}") for f in fields])
    named = read.select("*", *[F.schema_of_variant(f"_{f}").alias(f"_{f}_t") for f in fields])
    kinds = named.select("*", *[_kind(F.col(f"_{f}_t")).alias(f"{f}_k") for f in fields])

    def values(f: str) -> list[Column]:
        leaf, kind = F.col(f"_{f}"), F.col(f"{f}_k")
        number = F.when(F.col(f"_{f}_t") == "BOOLEAN", F.try_variant_get(leaf, "$", "boolean").cast("int").cast("double")).otherwise(
            F.try_variant_get(leaf, "$", "double"))
        return [kind, F.when(kind == "S", F.try_variant_get(leaf, "$", "string")).alias(f"{f}_s"),
                F.when(kind == "N", number).alias(f"{f}_n")]

    return kinds.select(*documents.columns, *[c for f in fields for c in values(f)])


def _kind(t: Column) -> Column:
    """Kind of a value by its type: null where it is missing or null (VOID)."""
    numeric = t == "BOOLEAN"
    for name in ("BIGINT", "INT", "DECIMAL", "DOUBLE", "FLOAT", "SMALLINT", "TINYINT"):
        numeric = numeric | t.startswith(name)
    return F.when(t == "STRING", "S").when(numeric, "N").when(t != "VOID", "O")


def write_items(items: DataFrame, path: str, hot: tuple[str, ...] = HOT, keyed: tuple[str, ...] = KEYED) -> ItemStore:
    """Parse and write items (item_key, version, date_modified, item_data); text that is no JSON has no document."""
    parsed = items.select("item_key", "version", "date_modified", F.try_parse_json("item_data").alias("doc"))
    rows = typed(parsed, hot)
    writer = rows.write.mode("overwrite")
    for c in ("item_key", *[f"{field}_s" for field in keyed if field in hot]):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(path)
    return open_items(items.sparkSession, path)


def open_items(spark: SparkSession, path: str) -> ItemStore:
    rows = spark.read.parquet(path)
    return ItemStore(rows, tuple(c[:-2] for c in rows.columns if c.endswith("_k")))
