"""Structured Streaming queries (#98-101, incremental #5).

Each query derives ordered file drops from the given tables into the shared
checkpoint folder, runs the stream to completion (``availableNow``, with a
checkpoint location), and returns the sink / final state as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import chunks_cte_from
from corpuskit.plans.threads import KIND
from corpuskit.sources import fixtures as X
from corpuskit.streaming import chat, ingest, ordered, quota, sync
from corpuskit.streaming.common import run_drops, scratch
from corpuskit.tables import Tables

INGESTED_AT = "2024-01-01T00:00:00+00:00"


def _file_stream(spark, folder: str, sample: DataFrame) -> DataFrame:
    return spark.readStream.schema(sample.schema).option("recursiveFileLookup", "true").parquet(folder)


QUOTA_LIMIT, QUOTA_WINDOW = 2, 3600  # low enough that the tables hold refused requests


@register("stream_quota", sql=f"""
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth
  FROM events),
step AS (
  SELECT event_id, user_id, ts, nth, true AS admitted, [us] AS held FROM ev WHERE nth = 1
  UNION ALL
  SELECT event_id, user_id, ts, nth, len(kept) < {QUOTA_LIMIT},
         CASE WHEN len(kept) < {QUOTA_LIMIT} THEN list_append(kept, us) ELSE kept END
  FROM (SELECT e.event_id, e.user_id, e.ts, e.nth, e.us,
               list_filter(s.held, lambda x: e.us - x < {QUOTA_WINDOW * 1_000_000}) AS kept
        FROM step s JOIN ev e ON e.user_id = s.user_id AND e.nth = s.nth + 1))
SELECT event_id, user_id, ts, admitted, CAST(len(held) AS INTEGER) AS in_window FROM step""")
def q_stream_quota(t: Tables) -> DataFrame:
    """#98: exact admission over events replayed as 4 time-ordered file drops."""
    spark = t.spark
    ev = t.events.select("event_id", "user_id", "ts")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    bounds = [] if lo is None else [lo + (hi - lo) / 4 * i for i in range(1, 4)]  # no events: one empty drop
    drops, prev = [], None
    for b in bounds + [None]:
        cond = (F.col("ts") > prev) if prev is not None else F.lit(True)
        cond = cond & (F.col("ts") <= b) if b is not None else cond
        drops.append(ev.filter(cond))
        prev = b
    src, out = scratch(spark, "quota-src"), scratch(spark, "quota-out")
    fn = quota.quota_batch_fn(out, scratch(spark, "quota-state"), QUOTA_LIMIT, QUOTA_WINDOW)
    run_drops(drops, src, lambda: _file_stream(spark, src, ev).writeStream.foreachBatch(fn), scratch(spark, "quota-ckpt"))
    return ordered.results(spark, out, quota.SCHEMA)


@register("stream_sync", sql=f"""
WITH {X.items_sql()}
SELECT item_key, version + 1 AS version FROM items
WHERE version >= 1 OR json_extract_string(item_data, '$.data.parentItem') IS NULL""")
def q_stream_sync(t: Tables) -> DataFrame:
    """#99: versioned item drops (versions 1..5) synced incrementally; final state."""
    spark = t.spark
    it = X.items(t).withColumn("version", F.col("version") + 1)
    drops = [it.filter(F.col("version") == v) for v in range(1, 6)]
    src, store = scratch(spark, "sync-src"), scratch(spark, "sync-items")
    fn = sync.sync_batch_fn(store, fold_after=3)  # so that the drops fold, and some stay open
    run_drops(drops, src, lambda: _file_stream(spark, src, it).writeStream.foreachBatch(fn), scratch(spark, "sync-ckpt"))
    return sync.item_table(spark, store, it.schema).read().select("item_key", "version")


_REVISED = "text || ' revised'"


@register("stream_ingest", sql=f"""
WITH _rdocs AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN {_REVISED} ELSE text END AS text FROM documents),
{chunks_cte_from('_rdocs', 'r', 'chunks')}
SELECT source_filename, count(*) AS n_chunks, max(total_chunks) AS total_chunks,
       md5(string_agg(content, chr(30) ORDER BY chunk_index)) AS content_md5
FROM chunks GROUP BY source_filename""")
def q_stream_ingest(t: Tables) -> DataFrame:
    """#100/#5: three document drops, then a re-ingest of the first drop's files
    with revised text; the store keeps only each file's latest chunks."""
    spark = t.spark
    d = t.documents.select("doc_id", "source", "text")
    drops = [d.filter(F.col("doc_id") % 3 == r).withColumn("seq", F.lit(r)) for r in range(3)]
    drops.append(d.filter(F.col("doc_id") % 3 == 0).withColumn("text", F.expr(_REVISED)).withColumn("seq", F.lit(3)))
    src, path = scratch(spark, "ingest-src"), scratch(spark, "ingest-store")
    fn = ingest.ingest_batch_fn(path, INGESTED_AT, fold_after=3)  # so that the drops fold, and one stays open
    run_drops(drops, src, lambda: _file_stream(spark, src, drops[0]).writeStream.foreachBatch(fn),
              scratch(spark, "ingest-ckpt"))
    store = ingest.stored_chunks(spark, path).read()
    return (store.groupBy("source_filename")
            .agg(F.count(F.lit(1)).alias("n_chunks"), F.max("total_chunks").cast("long").alias("total_chunks"),
                 F.md5(F.expr("listagg(content, '\\u001e') WITHIN GROUP (ORDER BY chunk_index)")).alias("content_md5")))


@register("stream_chat", sql=f"""
WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS text, {KIND} AS kind, coalesce(length(conversations.text) % 2 = 0, false) AS nohb
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'reasoning' THEN true WHEN kind = 'tool_call' THEN nohb
                                          WHEN kind = 'assistant' THEN false END IGNORE NULLS)
                           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                           false) AS pending
      FROM m),
c AS (SELECT *, CASE kind
        WHEN 'reasoning' THEN chr(10) || '- ' || regexp_replace(regexp_replace(trim(text), '^"', ''), '"$', '')
        WHEN 'tool_call' THEN chr(10) || '- Calling tool t' || CAST(turn AS VARCHAR)
                              || CASE WHEN nohb THEN ' *without heartbeat*' ELSE '' END || '...'
        WHEN 'tool_return' THEN ' success, returned ' || CAST(length(text) AS VARCHAR) || ' characters.'
        WHEN 'assistant' THEN CASE WHEN pending THEN '</think>' ELSE '' END || text END AS chunk
      FROM s)
SELECT conv_id, '<think>' || coalesce(string_agg(chunk, '' ORDER BY turn) FILTER (WHERE kind <> 'user'), '') AS reply
FROM c GROUP BY conv_id""")
def q_stream_chat(t: Tables) -> DataFrame:
    """#101: agent message chunks arrive in 3 drops (by turn); the fold's
    parts of a conversation, in order, are the full reply."""
    spark = t.spark
    m = t.conversations.select("conv_id", "turn", "text", F.expr(KIND).alias("kind"),
                               (F.length("text") % 2 == 0).alias("no_heartbeat"))
    drops = [m.filter(F.col("turn") < 2), m.filter((F.col("turn") >= 2) & (F.col("turn") < 4)),
             m.filter(F.col("turn") >= 4)]
    src, out = scratch(spark, "chat-src"), scratch(spark, "chat-out")
    fn = chat.chat_batch_fn(out, scratch(spark, "chat-state"))
    run_drops(drops, src, lambda: _file_stream(spark, src, m).writeStream.foreachBatch(fn), scratch(spark, "chat-ckpt"))
    return ordered.results(spark, out, chat.SCHEMA).groupBy("conv_id").agg(F.concat(
        F.lit("<think>"), F.expr("listagg(part, '') WITHIN GROUP (ORDER BY turn)")).alias("reply"))
