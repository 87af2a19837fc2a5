"""Document-style predicates over JSON items (#19, #20, #72).

A query is a dict ``{field: value}`` or a list of such dicts (AND). Fields
are paths under ``data``; ``a.b`` means "any element of ``data.a`` whose
``b`` matches" (only the first two parts are used). Values:

* primitive -> typed equality (text '5' never equals number 5; true equals 1 and
  false equals 0; null never matches)
* ``{"$ne": v}`` -> typed inequality, a missing / null field never matches
* ``{"$exists": True|False}`` -> present and not JSON null / missing or null
* ``$ne`` wins when both are given; a non-bool ``$exists`` skips the
  condition; a dict without a known operator compares with its Python text
* ``{}``, ``[]``, a non-dict element, or only skipped conditions -> no rows

``compile_query`` turns a query into one boolean ``Column`` on a VARIANT
column, so any number of predicates is evaluated in a single scan.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = object()


def conditions(query: Any) -> list[tuple[str, str, Any]] | None:
    """Normalise to ``[(field, op, value)]``; None means 'no rows'."""
    objs = [query] if isinstance(query, dict) else query
    if not isinstance(objs, list) or not objs:
        return None
    if any(not isinstance(q, dict) or not q for q in objs):
        return None
    out = []
    for q in objs:
        for field, value in q.items():
            if isinstance(value, dict):
                if "$ne" in value:
                    out.append((field, "ne", value["$ne"]))
                elif "$exists" in value:
                    if value["$exists"] is True:
                        out.append((field, "exists", True))
                    elif value["$exists"] is False:
                        out.append((field, "exists", False))
                    # any other $exists value: condition skipped
                else:
                    out.append((field, "eq", str(value)))
            else:
                out.append((field, "eq", value))
    return out or None


def _typed_cmp(var: Column, value: Any, op: str) -> Column:
    """Compare a VARIANT with a Python literal, types respected."""
    if value is None:
        return F.lit(None).cast("boolean")
    t = F.schema_of_variant(var)
    if isinstance(value, (int, float)):     # booleans are the numbers 1 and 0
        same_type = (t == "BOOLEAN") | t.startswith("BIGINT") | t.startswith("INT") | t.startswith("DECIMAL") | \
            t.startswith("DOUBLE") | t.startswith("FLOAT") | t.startswith("SMALLINT") | t.startswith("TINYINT")
        got = F.when(t == "BOOLEAN", F.try_variant_get(var, "$", "boolean").cast("int").cast("double")) \
            .otherwise(F.try_variant_get(var, "$", "double"))
        value = float(value)
    else:
        same_type = t == "STRING"
        got = F.try_variant_get(var, "$", "string")
    present = var.isNotNull() & ~F.is_variant_null(var)
    if op == "eq":
        return present & same_type & (got == F.lit(value))
    # $ne: SQL semantics, so null / missing never match; other types differ
    return present & (~same_type | (got != F.lit(value)))


def elements(v: Column, field: str) -> Column:
    """The array that a dotted path leads into."""
    return F.try_variant_get(v, f"$.data.{field.split('.')[0]}", "array<variant>")


def _cond(v: Column, field: str, op: str, value: Any, elems: Column | None = None) -> Column:
    """``elems``: the array of a dotted path, where it has been read already."""
    if "." in field:
        prop = field.split(".")[1]
        elems = elements(v, field) if elems is None else elems
        return F.coalesce(F.exists(elems, lambda x: _leaf(F.try_variant_get(x, f"$.{prop}", "variant"), op, value)),
                          F.lit(False))
    return _leaf(F.try_variant_get(v, f"$.data.{field}", "variant"), op, value)


def _leaf(var: Column, op: str, value: Any) -> Column:
    if op == "exists":
        present = var.isNotNull() & ~F.is_variant_null(var)
        return present if value else ~F.coalesce(present, F.lit(False))
    return F.coalesce(_typed_cmp(var, value, op), F.lit(False))


def compile_query(v: Column, query: Any) -> Column:
    """Boolean Column: does the item (VARIANT ``v``) match ``query``?"""
    conds = conditions(query)
    if conds is None:
        return F.lit(False)
    out = F.lit(True)
    for field, op, value in conds:
        out = out & _cond(v, field, op, value)
    return out


def condition_columns(v: Column, query: Any) -> list[Column]:
    """One boolean Column per condition (for the INTERSECT form, #72)."""
    conds = conditions(query)
    return [] if conds is None else [_cond(v, f, o, x) for f, o, x in conds]
