"""#98 stream_quota: exact sliding-window admission.

Per key, admitted request times younger than the window are kept in state;
a request is admitted while fewer than ``limit`` are held, otherwise it is
rejected and **not** counted. Within a micro-batch the rows of a key are
processed in (ts, id) order; across batches rows are processed as they
arrive (state holds at most ``limit`` timestamps per key, so it is bounded).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskit.operators.activity import QUOTA_REQUESTS, QUOTA_WINDOW_S
from corpuskit.streaming.ordered import batch_fn

OUT_SCHEMA = "event_id long, user_id long, ts timestamp, admitted boolean, in_window int"
STATE_SCHEMA = "admitted array<long>"


def admit(rows: list[tuple[int, int]], held: list[int], limit: int, window_us: int):
    """Plain fold used by the stateful function and by tests.

    rows: (micros, id) sorted; held: admitted micros still in state.
    Returns (decisions [(id, admitted, in_window)], new held)."""
    out = []
    held = list(held)
    for us, rid in rows:
        held = [h for h in held if us - h < window_us]
        ok = len(held) < limit
        if ok:
            held.append(us)
        out.append((rid, ok, len(held)))
    return out, held


def _fn(limit: int, window_s: int):
    window_us = window_s * 1_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(pdfs), ignore_index=True)
        batch = batch.sort_values(["ts", "event_id"], kind="mergesort", ignore_index=True)
        us = (batch["ts"].astype("datetime64[us]").astype("int64")).tolist()
        # decisions stand in the order of the rows: an event_id may repeat or be null
        decisions, held = admit([(x, i) for i, x in enumerate(us)], held, limit, window_us)
        state.update((held,))
        out = batch[["event_id", "user_id", "ts"]].copy()
        out["admitted"] = [d[1] for d in decisions]
        out["in_window"] = [d[2] for d in decisions]
        yield out

    return fn


def stream_quota(events: DataFrame, limit: int = QUOTA_REQUESTS, window_s: int = QUOTA_WINDOW_S) -> DataFrame:
    """Streaming DataFrame of admission decisions (append mode), one for each row:
    rows that repeat an event are requests of their own. Rows without a time
    are no requests and get no decision."""
    ev = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).filter(F.col("ts").isNotNull())
    return ev.groupBy("user_id").applyInPandasWithState(
        _fn(limit, window_s), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
MADE = "admitted boolean, in_window int"
SCHEMA = (T.StructType().add("event_id", T.LongType()).add("user_id", T.LongType()).add("ts", T.TimestampType())
          .add("admitted", T.BooleanType()).add("in_window", T.IntegerType()))


def prepared(events: DataFrame) -> DataFrame:
    """Requests: the rows with a user and a time."""
    ev = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.filter(F.col("ts").isNotNull() & F.col("user_id").isNotNull())


def quota_batch_fn(out: str, state_path: str, limit: int = QUOTA_REQUESTS, window_s: int = QUOTA_WINDOW_S,
                   idle_every: int = 8):
    """The same decisions by an ordered fold (``streaming.ordered``): no key's rows are held
    together, and users idle for a window are given up (requests that come more than a
    window behind the newest one may then find no state)."""
    window_us = window_s * 1_000_000

    def step(held, row):
        us = (row["ts"] - EPOCH) // dt.timedelta(microseconds=1)
        [(_, ok, n)], held = admit([(us, None)], held or [], limit, window_us)
        return held or None, {"admitted": ok, "in_window": n}

    def idle(state: DataFrame, rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        if newest is None:
            return state.limit(0).select("user_id")
        return state.filter(F.array_max("state") <= newest - window_us).select("user_id")

    return batch_fn(out, state_path, "user_id", ["ts", "event_id"], step, MADE, "array<long>", prepared, idle, idle_every)
