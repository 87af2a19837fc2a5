"""Stateful streaming operators against plain folds / batch twins."""

import datetime as dt

from corpuskit.streaming import chat, quota


def test_admit_fold():
    us = [0, 1, 2, 3, 10_000_000, 61_000_000]
    dec, held = quota.admit([(u, i) for i, u in enumerate(us)], [], limit=3, window_us=60_000_000)
    assert [d[1] for d in dec] == [True, True, True, False, False, True]
    assert held == [61_000_000] or len(held) <= 3


def test_stream_quota_matches_fold(spark, tmp_path):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    src = str(tmp_path / "src")
    df.write.parquet(src)
    stream = quota.stream_quota(spark.readStream.schema(df.schema).parquet(src), limit=3, window_s=60)
    q = stream.writeStream.format("memory").queryName("quota_t").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r.admitted for r in spark.sql("select * from quota_t").collect()}
    for user in (0, 1):
        mine = [(int(ts.timestamp() * 1e6), i) for i, u, ts in rows if u == user]
        dec, _ = quota.admit(mine, [], 3, 60_000_000)
        assert all(got[i] == ok for i, ok, _ in dec)


def test_chat_fold_rules():
    rows = [(0, "user", "hi", False), (1, "reasoning", '"think"', False), (2, "tool_call", "x", False),
            (3, "tool_return", "abc", False), (4, "assistant", "done", False), (5, "tool_call", "y", True),
            (6, "assistant", "again", False)]
    out, reply, _ = chat.fold(rows, "<think>", False)
    assert reply == ("<think>\n- think\n- Calling tool t2... success, returned 3 characters.done"
                     "\n- Calling tool t5 *without heartbeat*...</think>again")


def test_sliding_quota_brute_force(spark):
    from corpuskit.operators.activity import sliding_quota
    base = dt.datetime(2024, 1, 1)
    secs = [0, 0, 1, 59, 60, 60, 61, 119, 120, 200, 200, 200, 259, 260, 400]
    rows = [(i, 7, base + dt.timedelta(seconds=s)) for i, s in enumerate(secs)] + [(100, 8, base)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r.event_id: (r.in_window, r.over_quota) for r in sliding_quota(df, "user_id", "ts", 3, 60).collect()}
    for i, u, ts in rows:
        n = sum(1 for _, u2, t2 in rows if u2 == u and ts - dt.timedelta(seconds=60) < t2 <= ts)
        assert got[i] == (n, n > 3), (i, got[i], n)


def test_sliding_quota_repeated_rows_and_other_columns(spark):
    from corpuskit.operators.activity import sliding_quota
    base = dt.datetime(2024, 1, 1, 0, 0, 59)
    rows = [(1, 7, base, "a"), (1, 7, base, "b"), (2, 7, base + dt.timedelta(seconds=59), "c"),
            (3, 7, base + dt.timedelta(seconds=60), None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, note string")
    out = sliding_quota(df, "user_id", "ts", 2, 60)
    assert out.columns == [*df.columns, "in_window", "over_quota"]
    got = sorted((r.event_id, r.note, r.in_window, r.over_quota) for r in out.collect())
    assert got == [(1, "a", 2, False), (1, "b", 2, False), (2, "c", 3, True), (3, None, 2, False)]
    assert sliding_quota(df.limit(0), "user_id", "ts", 2, 60).count() == 0


def test_failure_streaks_brute_force(spark):
    from pyspark.sql import functions as F
    from corpuskit.operators.activity import failure_streaks
    base = dt.datetime(2024, 1, 1)
    pattern = "FFFSFFSFFFFSSFFF" + "F" * 5 + "SF"
    rows = [(i, 1, base + dt.timedelta(minutes=17 * i), c == "F") for i, c in enumerate(pattern)]
    rows += [(100 + i, 2, base + dt.timedelta(minutes=50 * i), True) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, failed boolean")
    got = sorted((r.user_id, r.n_failures, r._first.event_id) for r in
                 failure_streaks(df, "user_id", ["ts", "event_id"], F.col("failed"), 3, bucket_s=3600).collect())
    want = []
    for u in (1, 2):
        evs = sorted((r for r in rows if r[1] == u), key=lambda r: r[2])
        run = []
        for r in evs + [None]:
            if r is not None and r[3]:
                run.append(r)
            else:
                if len(run) >= 3:
                    want.append((u, len(run), run[0][0]))
                run = []
    assert got == sorted(want)


def test_conversation_views_bucketed_matches_fold(spark):
    from corpuskit.operators.activity import conversation_views
    kinds = ["user", "reasoning", "tool_call", "tool_return", "assistant", "tool_call", "assistant", "user"]
    rows = [(1, i, kinds[i % len(kinds)], f"t{i}", i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, kind string, text string, no_heartbeat boolean")
    got = conversation_views(df, turn_bucket=5).first()
    _, reply, _ = chat.fold([(t, k, x, h) for _, t, k, x, h in rows if k != "user"], "<think>", False)
    assert got.stream == reply


def test_stream_sync_restart_from_checkpoint(spark, tables_small, tmp_path):
    """Stop after three drops, add two more, restart from the same checkpoint:
    only the new files are processed and the state equals one full run."""
    from pyspark.sql import functions as F
    from corpuskit.plans import streams
    from corpuskit.sources import fixtures as X
    from corpuskit.streaming import sync
    from corpuskit.streaming.common import run_drops

    it = X.items(tables_small).withColumn("version", F.col("version") + 1)
    src, store, ckpt = (str(tmp_path / n) for n in ("src", "store", "ckpt"))
    fn = sync.sync_batch_fn(store, fold_after=2)
    query = lambda: streams._file_stream(spark, src, it).writeStream.foreachBatch(fn)
    run_drops([it.filter(F.col("version") == v) for v in (1, 2, 3)], src, query, ckpt)
    run_drops([it.filter(F.col("version") == v) for v in (4, 5)], f"{src}/late", query, ckpt)
    restarted = {(r.item_key, r.version) for r in sync.item_table(spark, store, it.schema).read().collect()}
    once = {(r.item_key, r.version) for r in streams.q_stream_sync(tables_small).collect()}
    assert restarted == once and len(once) > 0


def test_sync_epoch_replay_keeps_its_rows(spark, tmp_path):
    from corpuskit.streaming import sync

    path, schema = str(tmp_path / "items"), "item_key string, version long, item_data string"
    fn = sync.sync_batch_fn(path)
    first = spark.createDataFrame([("a", 1, '{"data": {}}'), ("b", 1, '{"data": {}}')], schema)
    second = spark.createDataFrame([("b", 2, '{"data": {}}'), ("a", 1, '{"data": {}}'), ("b", 3, '{"data": {}}')], schema)
    for batch, epoch in ((first, 0), (first, 0), (second, 1), (second, 1)):
        fn(batch, epoch)
    table = sync.item_table(spark, path, schema)
    assert {(r.item_key, r.version) for r in table.read().collect()} == {("a", 1), ("b", 3)}
    m = table.manifest()
    assert (m.version, m.epoch, m.position) == (2, 1, 3)  # a replayed epoch writes no version


def _run(spark, tmp_path, df, op, name):
    src = str(tmp_path / "src")
    df.write.parquet(src)
    q = op(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_stream_quota_decides_every_row_once(spark, tmp_path):
    """Repeated and missing event ids, rows without a time."""
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 7, at), (1, 7, at), (1, 7, at), (None, 7, at + dt.timedelta(seconds=1)), (2, 7, None), (3, 8, at)]
    got = _run(spark, tmp_path, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"),
               lambda s: quota.stream_quota(s, limit=2, window_s=60), "quota_rows")
    mine = sorted((r.event_id or 0, r.admitted, r.in_window) for r in got if r.user_id == 7)
    assert mine == [(0, False, 2), (1, False, 2), (1, True, 1), (1, True, 2)] and len(got) == 5


def test_stream_chat_with_missing_values(spark, tmp_path):
    rows = [(1, 0, "reasoning", None, None), (1, 1, "tool_call", None, None), (1, 2, "tool_return", None, False),
            (1, 3, "reasoning", "x", None), (1, 4, "assistant", None, None), (1, 5, None, "y", None),
            (None, 1, "assistant", "z", None), (1, None, "assistant", "z", None)]
    got = _run(spark, tmp_path, spark.createDataFrame(
        rows, "conv_id long, turn long, kind string, text string, no_heartbeat boolean"), chat.stream_chat, "chat_rows")
    assert [r.part for r in sorted(got, key=lambda r: r.turn)] == [
        "\n- ", "\n- Calling tool t1...", " success, returned 0 characters.", "\n- x", "</think>", ""]


def test_streams_over_empty_tables(spark, tables_small):
    from corpuskit.plans import streams

    class Nothing:
        def __init__(self):
            self.spark = spark

        def __getattr__(self, name):
            return getattr(tables_small, name).limit(0)

    assert streams.q_stream_quota(Nothing()).count() == 0
    assert streams.q_stream_chat(Nothing()).count() == 0


def test_ordered_quota_over_batches_and_replays(spark, tmp_path):
    """The fold over micro-batches equals one fold; a replayed epoch changes nothing; idle users are given up."""
    import random

    from corpuskit.streaming import ordered
    rng = random.Random(4)
    at = dt.datetime(2024, 1, 1)
    rows = sorted((at + dt.timedelta(seconds=rng.randint(0, 900)), i, rng.choice([1, 1, 1, 2, 3])) for i in range(400))
    rows += [(at + dt.timedelta(seconds=5000 + i), 1000 + i, 9) for i in range(3)]
    fn = quota.quota_batch_fn(str(tmp_path / "out"), str(tmp_path / "state"), limit=3, window_s=60, idle_every=6)
    for epoch in range(5):
        part = rows[epoch * 90:(epoch + 1) * 90] if epoch < 4 else rows[360:]
        df = spark.createDataFrame([(i, u, t) for t, i, u in part], "event_id long, user_id long, ts timestamp")
        fn(df, epoch)
        if epoch % 2:
            fn(df, epoch)
    got = {r.event_id: (r.admitted, r.in_window) for r in ordered.results(spark, str(tmp_path / "out"), quota.SCHEMA).collect()}
    want = {}
    for user in (1, 2, 3, 9):
        mine = [(int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), i) for t, i, u in rows if u == user]
        want |= {i: (ok, n) for i, ok, n in quota.admit(mine, [], 3, 60_000_000)[0]}
    assert got == want
    table = ordered.state_table(spark, str(tmp_path / "state"), "user_id", "array<long>")
    assert table.manifest().epoch == 4 and {r.user_id for r in table.read().collect()} == {1, 2, 3, 9}
    late = spark.createDataFrame([(5000, 9, at + dt.timedelta(seconds=9000))], "event_id long, user_id long, ts timestamp")
    fn(late, 5)
    assert {r.user_id for r in table.read().collect()} == {9}


def test_one_key_with_very_many_rows_in_one_batch(spark, tmp_path):
    """Arrow batches of a key follow one another; only the state is carried."""
    from pyspark.sql import functions as F

    from corpuskit.streaming import ordered
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "reasoning").otherwise("assistant").alias("kind"),
                                     F.lit("x").alias("text"), F.lit(False).alias("no_heartbeat"))
    chat.chat_batch_fn(str(tmp_path / "out"), str(tmp_path / "state"))(df.orderBy(F.rand(3)), 0)
    got = ordered.results(spark, str(tmp_path / "out"), chat.SCHEMA)
    assert got.count() == 100_000
    assert got.filter((F.col("turn") % 2 == 0) != (F.col("part") == "\n- x")).count() == 0
    assert got.filter((F.col("turn") % 2 == 1) != (F.col("part") == "</think>x")).count() == 0
