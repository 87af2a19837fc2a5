"""Threads, logs and conversations: quotas, failure streaks, problem records,
first success, preferred track, Q&A threads, issue text, conversation views,
calendar event search (#22-23, #53, #55, #58, #63, #66-70, #94, #96-97).

Grouped results use partial aggregates (``min_by``/``max_by``/``count``)
wherever the semantics allow, so a hot key is combined map-side; windows
are partitioned by the natural owner (user, conversation, question) and only
ever need a running frame.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import materialize

# --- fixed values ------------------------------------------------------------
QUOTA_REQUESTS = 30
QUOTA_WINDOW_S = 60
FAILURE_STREAK = 3
PROBLEM_TYPE_PREFIX = "urn:error:calendar:"
PROBLEM_INSTANCE_PREFIX = "/calendar_events/errors/"
# status -> (title, error type, instance prefix)
PROBLEMS = {
    401: ("Authentication Error", "GoogleAuthError", "auth"),
    403: ("Insufficient Permissions", "InsufficientPermissionsError", "perms"),
    404: ("Resource Not Found", "ResourceNotFoundError", "notfound"),
    429: ("Rate Limit Exceeded", "RateLimitError", "ratelimit"),
    400: ("Bad Request", "BadRequestError", "badrequest"),
}
OTHER_PROBLEM = ("API Error", "GoogleApiError", "apierror")
# mail: status -> (title, error type, detail); {m} message, {t} resource type, {i} resource id
MAIL_TYPE_PREFIX = "urn:error:mail:"
MAIL_PROBLEMS = {
    400: ("Invalid Input", "InvalidInputError", "Invalid request to Google API: {m}"),
    401: ("Authentication Error", "GoogleAuthError", "Authentication failed with Google API: {m}"),
    403: ("Permission Denied", "InsufficientPermissionsError", "Insufficient permissions for Google API operation: {m}"),
    404: ("Resource Not Found", "ResourceNotFoundError", "Google API resource not found: {m}"),
    429: ("Rate Limit Exceeded", "RateLimitError", "Google API rate limit exceeded: {m}"),
}
OTHER_MAIL_PROBLEM = ("Google API Error", "GoogleAPIError", "Google API request failed with status {s}: {m}")
# captions: kind -> (title, status, detail, instance); {v} video, {u} URL, {a} API tried, {e} error, {x} error type
TRANSCRIPT_TYPE_PREFIX = "urn:error:transcript:"
TRANSCRIPT_INSTANCE_PREFIX = "/youtube_transcripts/errors/"
TRANSCRIPT_PROBLEMS = {
    "invalid-url": ("Invalid YouTube URL", 400, "Could not extract video ID from the provided URL: {u}", "invalid-url-{u50}"),
    "transcripts-disabled": ("Transcripts Disabled", 403, "Transcripts are disabled for video {v} ({u}). API: {a}. "
                             "Original error: {e}", "disabled-{v}"),
    "no-transcript-found": ("No Transcript Found", 404, "No transcript found for video {v} ({u}). API: {a}. "
                            "Original error: {e}", "notfound-{v}"),
    "video-unavailable": ("Video Unavailable", 404, "Video {v} ({u}) is unavailable. API: {a}. Original error: {e}",
                          "unavailable-{v}"),
    "google-resource-not-found": ("Resource Not Found (Google API)", 404, "Google API reported resource not found for "
                                  "{v} ({u}). API: {a}. Original error: {e}", "google-notfound-{v}"),
    "google-auth-permission-error": ("Google API Authorization/Permission Error", 401, "Google API authorization or "
                                     "permission error for {v} ({u}). API: {a}. Original error: {e}", "google-auth-{v}"),
    "generic-fetch-error": ("Transcript Fetch Error", 500, "Failed to fetch transcript for video {v} ({u}) using {a}. "
                            "Original error: {x} - {e}", "generic-{v}"),
}
NO_MESSAGE = "No message found"
DEFAULT_EVENT_LIMIT_RANGE = 50
DEFAULT_EVENT_LIMIT_QUERY = 10
UNTITLED_QUESTION = "Untitled Question"
ANONYMOUS = "Anonymous"
# white space at both ends, as a full Unicode strip removes it
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
# -----------------------------------------------------------------------------


def sliding_quota(events: DataFrame, key: str, ts: str, limit: int = QUOTA_REQUESTS,
                  window_s: int = QUOTA_WINDOW_S) -> DataFrame:
    """#68 batch audit: requests of the same key in the trailing window
    ``(t - W, t]`` (``now - t < W``) and whether the request is over the limit.

    Exact, and split by time so a key holding a third of all rows is not one
    task: with buckets of width W, the window of a request in bucket b spans
    only buckets b-1 and b, so every request also visits the next bucket.
    There rows are ordered by their phase (time since their own bucket began):
    t and t - W have the same phase, hence

        in_window = #(own, phase <= p) + #(visiting) - #(visiting, phase <= p)

    One shuffle and one sort by (key, bucket), running counts only, no join;
    a visiting row carries nothing but its key and phase.
    """
    w_us = window_s * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = events.withColumn("_phase", F.pmod(micros, F.lit(w_us))).withColumn("_start", micros - F.col("_phase"))
    visiting = own.select(key, "_phase", (F.col("_start") + w_us).alias("_start"), F.lit(1).alias("_visit"))
    rows = own.withColumn("_visit", F.lit(0)).unionByName(visiting, allowMissingColumns=True)
    bucket = Window.partitionBy(key, "_start")
    upto = bucket.orderBy("_phase").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n_in = (F.sum(1 - F.col("_visit")).over(upto) + F.sum("_visit").over(bucket) - F.sum("_visit").over(upto))
    return (rows.withColumn("in_window", n_in.cast("long")).filter("_visit = 0")
            .withColumn("over_quota", F.col("in_window") > limit)
            .select(*events.columns, "in_window", "over_quota"))


def failure_streaks(log: DataFrame, key: str, order: list[str], failed: Column,
                    min_len: int = FAILURE_STREAK, bucket_s: int = 3600) -> DataFrame:
    """#69: runs of consecutive failures per key of length >= ``min_len``.

    Split by time so a hot key is not one window partition: events are
    bucketed by ``order[0]`` (a timestamp) into ``bucket_s`` buckets. Inside a
    (key, bucket) partition each failure learns whether its predecessor
    failed and the latest island start before it; only a one-row-per-bucket
    summary is windowed per key, to carry "previous bucket ended in a
    failure" and "last island start so far" across bucket boundaries.
    Output: ``key, n_failures, _first, _last`` (structs of the order columns).
    """
    ts, rest = order[0], order[1:]
    okey = F.struct(*[F.col(c) for c in order])
    ev = (log.withColumn("_f", failed).withColumn("_k", okey)
             .withColumn("_b", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bucket_s * 1_000_000))))
    wb = Window.partitionBy(key, "_b").orderBy(*order)
    ev = ev.withColumn("_prev_f", F.lag("_f").over(wb))
    summ = ev.groupBy(key, "_b").agg(F.min_by("_f", "_k").alias("_first_f"), F.max_by("_f", "_k").alias("_last_f"))
    wk = Window.partitionBy(key).orderBy("_b")
    summ = summ.withColumn("_carry_f", F.lag("_last_f").over(wk))
    ev = ev.join(summ.select(key, "_b", "_carry_f"), [key, "_b"])
    prev_failed = F.coalesce(F.col("_prev_f"), F.col("_carry_f"), F.lit(False))
    ev = ev.withColumn("_start", F.when(F.col("_f") & ~prev_failed, F.col("_k")))
    upto = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("_local", F.last("_start", ignorenulls=True).over(upto))
    starts = ev.groupBy(key, "_b").agg(F.max("_start").alias("_bstart"))
    carry = starts.withColumn(
        "_carry_start", F.last("_bstart", ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1)))
    ev = ev.join(carry.select(key, "_b", "_carry_start"), [key, "_b"])
    isl = ev.filter("_f").withColumn("_island", F.coalesce("_local", "_carry_start"))
    return (isl.groupBy(key, "_island")
               .agg(F.count(F.lit(1)).alias("n_failures"), F.min("_k").alias("_first"), F.max("_k").alias("_last"))
               .filter(F.col("n_failures") >= min_len).drop("_island"))


def dedupe_problems(problems: DataFrame, key: str, kind: str, seq: str) -> DataFrame:
    """#58: one problem per (key, type), the first by ``seq`` (partial aggregate)."""
    others = [c for c in problems.columns if c not in (key, kind)]
    first = F.min_by(F.struct(*others), F.col(seq))
    return problems.groupBy(key, kind).agg(first.alias("_p")).select(key, kind, "_p.*")


def to_problem(status: Column, resource_id: Column, message: Column, resource_type: Column) -> Column:
    """#96: status code -> RFC 7807 record (type, title, status, detail, instance)."""
    def pick(i):
        out = F.lit(OTHER_PROBLEM[i])
        for code, vals in reversed(list(PROBLEMS.items())):
            out = F.when(status == code, F.lit(vals[i])).otherwise(out)
        return out
    title, etype, suffix = pick(0), pick(1), pick(2)
    rid = F.coalesce(resource_id, F.lit("general"))
    detail = F.when(status == 404, F.concat(
        F.lit("Google "), F.coalesce(resource_type, F.lit("resource")), F.lit(" '"), F.coalesce(resource_id, F.lit("")),
        F.lit("' not found. API detail: "), message)).otherwise(message)
    return F.struct(F.concat(F.lit(PROBLEM_TYPE_PREFIX), etype).alias("type"), title.alias("title"),
                    status.cast("int").alias("status"), detail.alias("detail"),
                    F.concat(F.lit(PROBLEM_INSTANCE_PREFIX), suffix, F.lit("-"), rid).alias("instance"))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced by its column (null: empty)."""
    bits = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[b].cast("string"), F.lit("")) if i % 2 else F.lit(b) for i, b in enumerate(bits)])


def mail_problem(status: Column, message: Column, resource_type: Column, resource_id: Column,
                 prefix: str = MAIL_TYPE_PREFIX) -> Column:
    """#96: failed mail request -> problem record (type, title, status, detail,
    requires_reauth). A missing resource is named when it is known; no status counts as 500."""
    values = {"m": message, "s": status}

    def pick(i: int) -> Column:
        out = _fill(OTHER_MAIL_PROBLEM[i], values)
        for code, v in MAIL_PROBLEMS.items():
            out = F.when(status == code, _fill(v[i], values)).otherwise(out)
        return out
    named = (F.when(resource_id.isNotNull(), F.concat(resource_type, F.lit(" with ID '"), resource_id, F.lit("' not found.")))
              .otherwise(F.concat(resource_type, F.lit(" not found."))))
    detail = F.when((status == 404) & resource_type.isNotNull(), named).otherwise(pick(2))
    return F.struct(F.concat(F.lit(prefix), pick(1)).alias("type"), pick(0).alias("title"),
                    F.coalesce(status.cast("int"), F.lit(500)).alias("status"), detail.alias("detail"),
                    F.when(status == 401, F.lit(True)).alias("requires_reauth"))


def transcript_problem(kind: Column, video: Column, url: Column, api: Column, error: Column, error_type: Column,
                       denied: Column | None = None, prefix: str = TRANSCRIPT_TYPE_PREFIX) -> Column:
    """#96: failed caption fetch -> problem record (type, title, status, detail,
    instance). An unknown kind is a generic error; ``denied`` turns the status
    of an authorization error into 403."""
    values = {"v": video, "u": url, "u50": F.substring(url, 1, 50), "a": api, "e": error, "x": error_type}
    known = F.when(kind.isin(*TRANSCRIPT_PROBLEMS), kind).otherwise(F.lit("generic-fetch-error"))

    def pick(i: int) -> Column:
        out = F.lit(None)
        for name, v in TRANSCRIPT_PROBLEMS.items():
            out = F.when(known == name, F.lit(v[i]) if i == 1 else _fill(v[i], values)).otherwise(out)
        return out
    status = pick(1)
    if denied is not None:
        status = F.when((known == "google-auth-permission-error") & denied, F.lit(403)).otherwise(status)
    return F.struct(F.concat(F.lit(prefix), known).alias("type"), pick(0).alias("title"), status.cast("int").alias("status"),
                    pick(2).alias("detail"), F.concat(F.lit(TRANSCRIPT_INSTANCE_PREFIX), pick(3)).alias("instance"))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), " ", "-")


def first_success(log: DataFrame, key: str, attempt: str, content: str, handler: str) -> DataFrame:
    """#66: per key the first attempt with non-empty content; none -> failure row."""
    won = F.expr(f"min_by(struct({attempt}, {handler}, {content}), {attempt}) FILTER (WHERE length({content}) > 0)")
    return (log.groupBy(key).agg(won.alias("_w"), F.count(F.lit(1)).alias("attempts"))
               .select(key, "attempts", F.col("_w").isNotNull().alias("ok"),
                       F.col(f"_w.{attempt}").alias("won_attempt"), F.col(f"_w.{handler}").alias("handler"),
                       F.col(f"_w.{content}").alias("content")))


def preferred_track(tracks: DataFrame, key: str, lang: str, seq: str, preferred: str = "en") -> DataFrame:
    """#67: the preferred language, else the first track."""
    rank = F.struct((F.col(lang) != preferred).alias("_np"), F.col(seq).alias("_s"))
    return tracks.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in tracks.columns if c != key]), rank)
                                   .alias("_t")).select(key, "_t.*")


#: Rows of a group up to which ``numbered`` takes it whole.
WHOLE_GROUP = 4096


def numbered(df: DataFrame, group: list[str], blocks: list[Column], order: list[str], out: str = "pos",
             whole: int = WHOLE_GROUP) -> DataFrame:
    """Rows of each group numbered from 1 (``out``, long) by ``blocks``, then ``order``.

    Groups of at most ``whole`` rows are one window each: one shuffle. A group may
    hold most rows, so no window holds a larger one: its rows are numbered
    inside (group, block) and each block starts after the rows of the blocks
    before it, counted by a partial aggregate. Null blocks come first.
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    b = df.select("*", *[c.alias(n) for c, n in zip(blocks, names)])
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole)
    large = materialize(large.select(*[F.col(c).alias(f"_l_{c}") for c in group]))
    together = Window.partitionBy(*group).orderBy(*names, *order)

    def at_once(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(together).cast("long")).select(*df.columns, out)

    if not large.count():
        return at_once(b)
    own = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in group])
    small, b = b.join(large, own, "left_anti"), b.join(large, own, "left_semi")
    sizes = b.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in [*group, *names]],
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = None
    for c in [*group, *names]:
        eq = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        same = eq if same is None else same & eq
    w = Window.partitionBy(*group, *names).orderBy(*order)
    split = b.join(starts, same).withColumn(out, F.col("_start") + F.row_number().over(w)).select(*df.columns, out)
    return at_once(small).unionByName(split)


def sort_answers(answers: DataFrame, question: str, score: str, seq: str, block: int = 1024) -> DataFrame:
    """#63: by score desc (missing = 0), stable on the original order
    (``answer_pos``, int). Works in blocks of one score and ``block`` places."""
    r = numbered(answers, [question], [-F.coalesce(F.col(score), F.lit(0)), F.floor(F.col(seq) / block)], [seq],
                 "answer_pos")
    return r.withColumn("answer_pos", F.col("answer_pos").cast("int"))


def thread_filter(threads: DataFrame, tags: list[str], limit: int, min_score: float, order: list[Column],
                  tags_col: str = "tags", score: str = "score") -> DataFrame:
    """#23: all tags (lower-cased) must be present; the first ``limit`` in
    source order are taken **before** the score filter; missing score = 0."""
    want = F.array(*[F.lit(t.lower()) for t in tags])
    hit = threads.filter(F.size(F.array_except(want, F.transform(tags_col, F.lower))) == 0)
    first = hit.orderBy(*order).limit(limit)
    return first.filter(F.coalesce(F.col(score), F.lit(0)) >= min_score)


def issue_text(docs: DataFrame, key: str, seq: str, title: str, content: str, author: str) -> DataFrame:
    """#55: first document is the issue, the rest comments, one text per issue."""
    line = F.when(F.col(seq) == 0, F.concat(
        F.lit('"**Issue Title:** '), F.coalesce(F.col(title), F.lit("")), F.lit('\n"**Issue Description:** '),
        F.coalesce(F.col(content), F.lit("")))).otherwise(F.concat(
            F.lit("**Comment by "), F.coalesce(F.col(author), F.lit("")), F.lit(":** "),
            F.coalesce(F.col(content), F.lit(""))))
    return (docs.withColumn("_line", line).groupBy(key)
            .agg(F.expr(f"listagg(_line, '\\n') WITHIN GROUP (ORDER BY {seq})").alias("issue_text"),
                 F.count(F.lit(1)).alias("n_docs")))


# ---------------------------------------------------------- conversations

def conversation_views(msgs: DataFrame, key: str = "conv_id", seq: str = "turn", kind: str = "kind",
                       text: str = "text", no_heartbeat: str = "no_heartbeat", turn_bucket: int = 256) -> DataFrame:
    """#97: last user message, first assistant message (or a fixed text), and
    the rendered reply stream.

    ``kind``: user / reasoning / tool_call / tool_return / assistant. Stream
    state: reasoning sets "close think pending", a tool call sets it only
    when it asked for no heartbeat, a tool return leaves it, an assistant
    message closes it (emitting ``</think>``) and clears it.
    """
    k = F.col(kind)
    flag = (F.when(k == "reasoning", F.lit(True)).when(k == "tool_call", F.col(no_heartbeat))
             .when(k == "assistant", F.lit(False)))
    # "pending" = last non-null flag before the row. Split by (conversation,
    # turn bucket) so a huge conversation is not one window partition: the
    # in-bucket value comes from a running window, the carry from a
    # one-row-per-bucket summary windowed per conversation.
    msgs = msgs.withColumn("_flag", flag).withColumn("_b", F.floor(F.col(seq) / F.lit(turn_bucket)))
    prev = Window.partitionBy(key, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = F.last("_flag", ignorenulls=True).over(prev)
    summ = msgs.groupBy(key, "_b").agg(F.expr(f"max_by(_flag, {seq}) FILTER (WHERE _flag IS NOT NULL)").alias("_lf"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_carry", F.last("_lf", ignorenulls=True).over(before)).select(key, "_b", "_carry")
    msgs = msgs.join(summ, [key, "_b"])
    pending = F.coalesce(local, F.col("_carry"), F.lit(False))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), STRIP, ""), r'^"', ""), r'"$', "")
    chunk = (F.when(k == "reasoning", F.concat(F.lit("\n- "), body))
              .when(k == "tool_call", F.concat(F.lit("\n- Calling tool t"), F.col(seq).cast("string"),
                                               F.when(F.col(no_heartbeat), F.lit(" *without heartbeat*"))
                                                .otherwise(F.lit("")), F.lit("...")))
              .when(k == "tool_return", F.concat(F.lit(" success, returned "),
                                                 F.length(F.col(text)).cast("string"), F.lit(" characters.")))
              .when(k == "assistant", F.concat(F.when(pending, F.lit("</think>")).otherwise(F.lit("")), F.col(text))))
    rows = msgs.withColumn("_chunk", chunk)
    return rows.groupBy(key).agg(
        F.expr(f"max_by({text}, {seq}) FILTER (WHERE {kind} = 'user')").alias("last_user"),
        F.coalesce(F.expr(f"min_by({text}, {seq}) FILTER (WHERE {kind} = 'assistant')"),
                   F.lit(NO_MESSAGE)).alias("first_assistant"),
        F.concat(F.lit("<think>"), F.coalesce(
            F.expr(f"listagg(_chunk, '') WITHIN GROUP (ORDER BY {seq}) FILTER (WHERE {kind} <> 'user')"),
            F.lit(""))).alias("stream"))


# -------------------------------------------------------------- calendar

def event_search(events: DataFrame, event_id: str | None = None, query: str | None = None,
                 start: str | None = None, end: str | None = None, order_by: str = "startTime",
                 max_results: int | None = None, id_col: str = "id", text_cols: tuple[str, ...] = ("summary",),
                 start_col: str = "start_ts", updated_col: str = "updated_ts") -> DataFrame:
    """#22: by id; or text query (optional bounds); or start+end (both
    required). Ordered by start or updated, then id; default limit 50 for a
    range, 10 for a query. Argument errors raise in the driver."""
    if event_id is not None:
        return events.filter(F.col(id_col) == event_id).withColumn("pos", F.lit(1))
    if query is None and (start is None or end is None):
        raise ValueError("a time range needs both start and end")
    q = events
    if query is not None:
        hit = F.lit(False)
        for c in text_cols:
            hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.lower())
        q = q.filter(hit)
    if start is not None:
        q = q.filter(F.col(start_col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        q = q.filter(F.col(start_col) <= F.lit(end).cast("timestamp"))
    limit = max_results if max_results and max_results > 0 else (
        DEFAULT_EVENT_LIMIT_QUERY if query is not None else DEFAULT_EVENT_LIMIT_RANGE)
    key = F.col(start_col) if order_by == "startTime" else F.col(updated_col)
    top = q.orderBy(key, F.col(id_col)).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(key, F.col(id_col))))


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 date, or date and time ("T" or a space; seconds, fraction and
    offset optional; naive = UTC), else null."""
    full = F.regexp_replace(text, r"^(\S{10})[T ](\d{2}:\d{2})(?=$|Z|[+-])", "$1T$2:00")
    return F.when(text.rlike(_ISO), full.try_cast("timestamp"))


def normalize_bound(text: Column | None = None, date: Column | None = None, end: bool = False) -> Column:
    """#88: text (ISO, trailing Z or offset; naive = UTC) or date -> UTC
    timestamp; a date as an end bound is the last microsecond of the day."""
    if text is not None:
        return iso_timestamp(text)
    ts = date.cast("timestamp")
    return ts + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND") if end else ts
