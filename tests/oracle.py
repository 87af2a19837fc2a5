"""Spark-vs-DuckDB comparison in the driver's style.

Columns are compared by sorted name, then row count, then an
order-insensitive hash of the normalised values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb
import numpy as np

from corpuskit.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float) and math.isnan(v):
        return "∅"
    if isinstance(v, (np.integer,)):
        v = int(v)
    if isinstance(v, (np.floating,)):
        v = float(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def table_hash(cols: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), h


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT",
                 "TimestampType()": "TIMESTAMP", "DateType()": "DATE", "ShortType()": "SMALLINT"}


def type_mismatches(spark_df, sql: str, con) -> dict:
    """Columns whose Spark type differs from the oracle's DuckDB type."""
    st = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in spark_df.schema.fields}
    dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c)}


def compare(spark_df, sql: str, con) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "schema_ok": sorted(s_cols) == sorted(d_cols)}
    if not out["schema_ok"]:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(d_cols)
        out["ok"] = False
        return out
    bad_types = type_mismatches(spark_df, sql, con)
    out["types_ok"] = not bad_types
    if bad_types:
        out["type_mismatches"] = bad_types
    _, hs = table_hash(s_cols, s_rows)
    _, hd = table_hash(d_cols, d_rows)
    out["hash_ok"] = hs == hd
    out["ok"] = out["hash_ok"] and len(s_rows) == len(d_rows) and out["types_ok"]
    if not out["ok"]:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ls = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        ld = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
        only_s = sorted(set(ls) - set(ld))[:3]
        only_d = sorted(set(ld) - set(ls))[:3]
        out["cols"] = [s_cols[i] for i in order_s]
        out["only_spark"] = [x[:400] for x in only_s]
        out["only_oracle"] = [x[:400] for x in only_d]
    return out
