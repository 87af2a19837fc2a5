"""#101 stream_chat: incremental fold of agent message chunks into a reply.

State per conversation: whether ``</think>`` is pending (same rules as #97's
stream view). Every incoming row emits the part it adds, so output grows with
the input; the parts in turn order, after ``<think>``, are the reply.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskit.streaming.ordered import batch_fn

OUT_SCHEMA = "conv_id long, turn long, part string"
STATE_SCHEMA = "pending boolean"


def fold(rows: list[tuple], reply: str, pending: bool):
    """rows: (turn, kind, text, no_heartbeat) sorted by turn; returns the parts
    (turn, text), the reply with them, and the pending flag. A null text counts
    as an empty one, a null flag as false; other kinds add an empty part."""
    out = []
    for turn, kind, text, nohb in rows:
        text, nohb = text or "", nohb is not None and bool(nohb)
        part = ""
        if kind == "reasoning":
            t = text.strip()
            t = t[1:] if t.startswith('"') else t
            t = t[:-1] if t.endswith('"') else t
            part = "\n- " + t
            pending = True
        elif kind == "tool_call":
            part = f"\n- Calling tool t{turn}" + (" *without heartbeat*" if nohb else "") + "..."
            pending = bool(nohb)
        elif kind == "tool_return":
            part = f" success, returned {len(text)} characters."
        elif kind == "assistant":
            part = ("</think>" if pending else "") + text
            pending = False
        out.append((turn, part))
    return out, reply + "".join(p for _, p in out), pending


def _fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (pending,) = state.get if state.exists else (False,)
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values("turn", kind="mergesort")
    # missing values of pandas columns are None here
    whole = batch.astype(object).where(batch.notna(), None)
    rows = list(zip(batch["turn"], whole["kind"], whole["text"], whole["no_heartbeat"]))
    out, _, pending = fold(rows, "", pending)
    state.update((bool(pending),))
    yield pd.DataFrame({"conv_id": key[0], "turn": [t for t, _ in out], "part": [p for _, p in out]})


def stream_chat(msgs: DataFrame) -> DataFrame:
    """``msgs``: conv_id, turn, kind, text, no_heartbeat (streaming). Rows without a
    conversation or turn take no part."""
    msgs = msgs.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    return msgs.groupBy("conv_id").applyInPandasWithState(
        _fn, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


SCHEMA = (T.StructType().add("conv_id", T.LongType()).add("turn", T.LongType()).add("kind", T.StringType())
          .add("text", T.StringType()).add("no_heartbeat", T.BooleanType()).add("part", T.StringType()))


def prepared(msgs: DataFrame) -> DataFrame:
    return msgs.select("conv_id", F.col("turn").cast("long").alias("turn"), "kind", "text", "no_heartbeat").filter(
        "conv_id IS NOT NULL AND turn IS NOT NULL")


def chat_batch_fn(out: str, state_path: str):
    """The same parts by an ordered fold (``streaming.ordered``): no conversation's rows are held together."""
    def step(pending, row):
        [(_, part)], _, pending = fold([(row["turn"], row["kind"], row["text"], row["no_heartbeat"])], "", bool(pending))
        return pending or None, {"part": part}

    return batch_fn(out, state_path, "conv_id", ["turn"], step, "part string", "boolean", prepared)
