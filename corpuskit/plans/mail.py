"""Mail, calendar, transcript and trace queries (#21-22, #59, #87-93, #95).

Messages come from ``conversations`` (one message per turn, four MIME tree
shapes by turn), calendar events from ``events``, captions from
``documents`` (8 words per caption), stack traces from ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import activity as A
from corpuskit.operators import results
from corpuskit.operators import mail as M
from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import sql_str
from corpuskit.tables import Tables

# ------------------------------------------------------------- messages
_TS_SECS = "1704067200 + conv_id * 86400 + turn * 3600"
H_FROM = "'\"' || role || '\" <' || role || '.' || CAST(conv_id AS STRING) || '@example.com>'"
H_TO = "'a' || CAST(conv_id AS STRING) || '@example.org, b' || CAST(turn AS STRING) || '@example.net'"
H_CC = "CASE WHEN turn % 2 = 0 THEN 'a' || CAST(conv_id AS STRING) || '@example.org; c@x.io' ELSE '' END"
H_SUBJ = "'Re: thread ' || CAST(conv_id AS STRING) || ' / ' || role"


def _spark_date(ts: Column) -> Column:
    t = F.col("turn") % 5
    return (F.when(t == 0, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0700 (PDT)")))
             .when(t == 1, F.concat(F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
             .when(t == 2, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"))
             .when(t == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")))
             .otherwise(F.lit("yesterday")))


_DATE_SQL = ("CASE turn % 5 WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' -0700 (PDT)' "
             "WHEN 1 THEN strftime(ts, '%d %b %Y %H:%M:%S') || ' +0200' "
             "WHEN 2 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') "
             "WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' ELSE 'yesterday' END")


def messages(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("ts", F.timestamp_seconds(F.expr(_TS_SECS)))
    hdr = lambda n, e: F.struct(F.lit(n).alias("name"), e.alias("value"))
    headers = F.array(hdr("From", F.expr(H_FROM)), hdr("to", F.expr(H_TO)), hdr("Cc", F.expr(H_CC)),
                      hdr("Subject", F.expr(H_SUBJ)), hdr("SUBJECT", F.lit("second subject")),
                      hdr("Date", _spark_date(F.col("ts"))))
    labels = (F.when(F.col("turn") % 4 == 0, F.array(F.lit("INBOX"), F.lit("UNREAD")))
               .when(F.col("turn") % 4 == 1, F.array(F.lit("INBOX")))
               .when(F.col("turn") % 4 == 2, F.array(F.lit("SPAM")))
               .otherwise(F.array(F.lit("TRASH"), F.lit("STARRED"))))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "conv_id", "turn", "text",
                    headers.alias("headers"), labels.alias("labels"),
                    (F.expr(_TS_SECS) * 1000).cast("string").alias("internal_ms"))


MSG_SQL = f"""_c AS (SELECT *, make_timestamp(CAST(({_TS_SECS}) AS BIGINT) * 1000000) AS ts FROM conversations),
_m AS (
  SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, text,
         [{{'name': 'From', 'value': {H_FROM.replace('AS STRING', 'AS VARCHAR')}}},
          {{'name': 'to', 'value': {H_TO.replace('AS STRING', 'AS VARCHAR')}}},
          {{'name': 'Cc', 'value': {H_CC.replace('AS STRING', 'AS VARCHAR')}}},
          {{'name': 'Subject', 'value': {H_SUBJ.replace('AS STRING', 'AS VARCHAR')}}},
          {{'name': 'SUBJECT', 'value': 'second subject'}},
          {{'name': 'Date', 'value': {_DATE_SQL}}}] AS headers,
         CASE turn % 4 WHEN 0 THEN ['INBOX', 'UNREAD'] WHEN 1 THEN ['INBOX'] WHEN 2 THEN ['SPAM']
              ELSE ['TRASH', 'STARRED'] END AS labels,
         CAST(({_TS_SECS}) * 1000 AS VARCHAR) AS internal_ms
  FROM _c
)"""


def _b64(x: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(F.encode(x, "UTF-8")), r"\s", ""), "+/", "-_")


BAD_UTF8 = "__54"   # base64url of bytes ff fe 78: not UTF-8


def parts(t: Tables) -> DataFrame:
    """Flattened MIME trees: four shapes by turn."""
    m = messages(t)
    txt = F.col("text")
    P = lambda path, mime, anc, data: F.struct(
        F.array(*[F.lit(i) for i in path]).cast("array<int>").alias("path"), F.lit(mime).alias("mime"),
        F.array(*[F.lit(a) for a in anc]).cast("array<string>").alias("ancestors"),
        (data if data is not None else F.lit(None).cast("string")).alias("data"))
    mx, alt, rel = "multipart/mixed", "multipart/alternative", "multipart/related"
    shapes = [
        F.array(P([], "text/plain", [], _b64(txt))),
        F.array(P([], alt, [], None), P([0], "text/html", [alt], _b64(F.concat(F.lit("<p>"), txt, F.lit("</p>")))),
                P([1], "text/plain", [alt], _b64(txt))),
        F.array(P([], mx, [], None), P([0], alt, [mx], None), P([0, 0], "text/html", [mx, alt], _b64(txt)),
                P([0, 1], "text/plain", [mx, alt], _b64(txt)), P([1], "application/pdf", [mx], _b64(F.lit("%PDF")))),
        F.array(P([], mx, [], None), P([0], "text/plain", [mx], F.lit(BAD_UTF8)), P([1], alt, [mx], None),
                P([1, 0], rel, [mx, alt], None), P([1, 0, 0], "text/plain", [mx, alt, rel], _b64(txt)),
                P([2], "text/plain", [mx], _b64(F.concat(F.lit("P.S. "), txt)))),
    ]
    t4 = F.col("turn") % 4
    arr = F.when(t4 == 0, shapes[0]).when(t4 == 1, shapes[1]).when(t4 == 2, shapes[2]).otherwise(shapes[3])
    return m.select("msg_id", F.explode(arr).alias("p")).select("msg_id", "p.*")


def _b64_sql(x: str) -> str:
    return f"translate(to_base64(encode({x})), '+/', '-_')"


def _p(path, mime, anc, data):
    pl = "[" + ", ".join(str(i) for i in path) + "]::INTEGER[]"
    al = "[" + ", ".join(sql_str(a) for a in anc) + "]::VARCHAR[]"
    return f"{{'path': {pl}, 'mime': {sql_str(mime)}, 'ancestors': {al}, 'data': {data or 'NULL::VARCHAR'}}}"


_MX, _ALT, _REL = "multipart/mixed", "multipart/alternative", "multipart/related"
PARTS_SQL = f"""_parts AS (
  SELECT msg_id, unnest(CASE turn % 4
    WHEN 0 THEN [{_p([], 'text/plain', [], _b64_sql('text'))}]
    WHEN 1 THEN [{_p([], _ALT, [], None)}, {_p([0], 'text/html', [_ALT], _b64_sql("'<p>' || text || '</p>'"))},
                 {_p([1], 'text/plain', [_ALT], _b64_sql('text'))}]
    WHEN 2 THEN [{_p([], _MX, [], None)}, {_p([0], _ALT, [_MX], None)}, {_p([0, 0], 'text/html', [_MX, _ALT], _b64_sql('text'))},
                 {_p([0, 1], 'text/plain', [_MX, _ALT], _b64_sql('text'))}, {_p([1], 'application/pdf', [_MX], _b64_sql("'%PDF'"))}]
    ELSE [{_p([], _MX, [], None)}, {_p([0], 'text/plain', [_MX], sql_str(BAD_UTF8))}, {_p([1], _ALT, [_MX], None)},
          {_p([1, 0], _REL, [_MX, _ALT], None)}, {_p([1, 0, 0], 'text/plain', [_MX, _ALT, _REL], _b64_sql('text'))},
          {_p([2], 'text/plain', [_MX], _b64_sql("'P.S. ' || text"))}] END, recursive := true)
  FROM _m
)"""


BODY_SQL = """_body AS (
  SELECT msg_id, arg_min(b, path) FILTER (WHERE ok) AS plain_text_body FROM (
    SELECT msg_id, path, try(decode(from_base64(translate(data, '-_', '+/')))) AS b,
           mime = 'text/plain'
           AND len(list_filter(ancestors, lambda a: NOT starts_with(a, 'multipart/'))) = 0
           AND NOT list_contains(ancestors[1:greatest(len(ancestors) - 1, 0)], 'multipart/alternative')
           AND try(decode(from_base64(translate(data, '-_', '+/')))) IS NOT NULL
           AND length(try(decode(from_base64(translate(data, '-_', '+/'))))) > 0 AS ok
    FROM _parts) GROUP BY msg_id
)"""


@register("plain_body", sql=f"""
WITH {MSG_SQL}, {PARTS_SQL}, {BODY_SQL}
SELECT msg_id, CAST(length(plain_text_body) AS BIGINT) AS n_chars, md5(plain_text_body) AS body_md5 FROM _body""")
def q_plain_body(t: Tables) -> DataFrame:
    """#90: first depth-first text/plain part (alternative: direct children only)."""
    b = M.plain_body(parts(t))
    return b.select("msg_id", F.length("plain_text_body").cast("long").alias("n_chars"),
                    F.md5("plain_text_body").alias("body_md5"))


def _hdr_sql(name: str) -> str:
    return f"list_filter(headers, lambda h: lower(h.name) = '{name.lower()}')[1].value"


def _date_sql(v: str) -> str:
    s = f"regexp_replace(trim({v}), '\\s*\\([A-Z]+\\)$', '')"
    nw = f"regexp_replace({s}, '^[A-Za-z]{{3}}, ', '')"
    return (f"coalesce(timezone('UTC', try_strptime({nw}, '%d %b %Y %H:%M:%S %z')), "
            f"try_strptime({nw}, '%d %b %Y %H:%M:%S'), timezone('UTC', try_strptime({s}, '%Y-%m-%dT%H:%M:%S%z')))")


_EMAIL = M.EMAIL_RE


@register("parse_message", sql=f"""
WITH {MSG_SQL}
SELECT msg_id, {_hdr_sql('Subject')} AS subject,
       CASE WHEN regexp_matches({_hdr_sql('From')}, '{_EMAIL}') THEN regexp_extract({_hdr_sql('From')}, '{_EMAIL}', 0) END
         AS sender_email,
       strftime({_date_sql(_hdr_sql('Date'))}, '%Y-%m-%d %H:%M:%S') AS sent_date,
       strftime(make_timestamp(CAST(internal_ms AS BIGINT) * 1000), '%Y-%m-%d %H:%M:%S') AS internal_date
FROM _m""")
def q_parse_message(t: Tables) -> DataFrame:
    """#89: headers (case-insensitive, first wins), sender, date in 4 formats, internal date."""
    p = M.parse_message(messages(t))
    return p.select("msg_id", "subject", "sender_email",
                    F.date_format("sent_date", "yyyy-MM-dd HH:mm:ss").alias("sent_date"),
                    F.date_format("internal_date", "yyyy-MM-dd HH:mm:ss").alias("internal_date"))


@register("context_mail", sql=f"""
WITH {MSG_SQL}, {PARTS_SQL}, {BODY_SQL}
SELECT msg_id, md5('  --- Email Start ---' || chr(10) || '  Subject: ' || coalesce({_hdr_sql('Subject')}, '') || chr(10)
  || '  From: ' || coalesce({_hdr_sql('From')}, '') || chr(10) || '  Date: ' || coalesce({_hdr_sql('Date')}, '') || chr(10)
  || '  Snippet: ' || coalesce(split_part(text, '.', 1), '') || chr(10) || '  Content: ' || coalesce(plain_text_body, '') || chr(10)
  || '  --- Email End ---') AS block_md5
FROM _m LEFT JOIN _body USING (msg_id)""")
def q_context_mail(t: Tables) -> DataFrame:
    """#47: the context block of every message."""
    m, h = messages(t), F.col("headers")
    j = m.join(M.plain_body(parts(t)), "msg_id", "left")
    block = results.mail_block(M.header(h, "Subject"), M.header(h, "From"), M.header(h, "Date"),
                               F.split_part("text", F.lit("."), F.lit(1)), F.col("plain_text_body"))
    return j.select("msg_id", F.md5(block).alias("block_md5"))


@register("distinct_recipients", sql=f"""
WITH {MSG_SQL}
SELECT msg_id, array_to_string(list_sort(list_distinct(flatten([
         coalesce(regexp_extract_all(coalesce({_hdr_sql('To')}, ''), '{_EMAIL}'), []),
         coalesce(regexp_extract_all(coalesce({_hdr_sql('Cc')}, ''), '{_EMAIL}'), [])]))), ',') AS recipients
FROM _m""")
def q_distinct_recipients(t: Tables) -> DataFrame:
    """#59: unique To + Cc addresses (sorted for a set comparison)."""
    m = messages(t)
    return m.select("msg_id", F.array_join(M.recipients(F.col("headers")), ",").alias("recipients"))


MAIL_AS_OF = "2024-03-01 00:00:00"
MAIL_FILTERS = {
    "from_user_recent": dict(sender="user.", newer_than_days=40),
    "to_net_unread": dict(recipient="example.net", unread=True),
    "attach_phrase": dict(has_attachment=True, any_of=["le", "the"], exclude="zzz"),
    "all_labels_spam_ok": dict(labels=["TRASH", "STARRED"], include_spam_trash=True, subject="thread 1"),
}


def parsed_messages(t: Tables) -> DataFrame:
    p = M.parse_message(messages(t))
    b = M.plain_body(parts(t))
    att = parts(t).groupBy("msg_id").agg(F.max(F.col("mime").startswith("application/")).alias("has_attachment"))
    return p.join(b.withColumnRenamed("plain_text_body", "body"), "msg_id", "left").join(att, "msg_id", "left")


def _filter_sql(name: str, f: dict) -> str:
    c = ["true"]
    txt = "(lower(coalesce(subject, '')) || ' ' || lower(coalesce(body, '')))"
    if f.get("sender"):
        c.append(f"contains(lower(coalesce(sender_email, '')), {sql_str(f['sender'].lower())})")
    if f.get("recipient"):
        c.append(f"len(list_filter(recipient_emails, lambda r: contains(lower(r), {sql_str(f['recipient'].lower())}))) > 0")
    if f.get("subject"):
        c.append(f"contains(lower(coalesce(subject, '')), {sql_str(f['subject'].lower())})")
    if f.get("has_attachment") is not None:
        c.append(f"has_attachment = {str(f['has_attachment']).lower()}")
    if f.get("newer_than_days") is not None:
        c.append(f"internal_date >= TIMESTAMP '{MAIL_AS_OF}' - INTERVAL {f['newer_than_days']} DAY")
    for lab in f.get("labels") or []:
        c.append(f"list_contains(labels, {sql_str(lab)})")
    if f.get("unread") is not None:
        c.append(f"list_contains(labels, 'UNREAD') = {str(f['unread']).lower()}")
    if f.get("any_of"):
        c.append("(" + " OR ".join(f"contains({txt}, {sql_str(w.lower())})" for w in f["any_of"]) + ")")
    if f.get("exclude"):
        c.append(f"NOT contains({txt}, {sql_str(f['exclude'].lower())})")
    if not f.get("include_spam_trash"):
        c.append("NOT (list_contains(labels, 'SPAM') OR list_contains(labels, 'TRASH'))")
    return f"SELECT '{name}' AS filter_name, msg_id FROM pm WHERE " + " AND ".join(c)


@register("mail_filter", sql=f"""
WITH {MSG_SQL}, {PARTS_SQL}, {BODY_SQL},
pm AS (
  SELECT m.msg_id, m.labels, {_hdr_sql('Subject')} AS subject,
         CASE WHEN regexp_matches({_hdr_sql('From')}, '{_EMAIL}') THEN regexp_extract({_hdr_sql('From')}, '{_EMAIL}', 0) END
           AS sender_email,
         list_sort(list_distinct(flatten([coalesce(regexp_extract_all(coalesce({_hdr_sql('To')}, ''), '{_EMAIL}'), []),
                                          coalesce(regexp_extract_all(coalesce({_hdr_sql('Cc')}, ''), '{_EMAIL}'), [])])))
           AS recipient_emails,
         make_timestamp(CAST(m.internal_ms AS BIGINT) * 1000) AS internal_date, b.plain_text_body AS body,
         (SELECT max(starts_with(mime, 'application/')) FROM _parts p WHERE p.msg_id = m.msg_id) AS has_attachment
  FROM _m m LEFT JOIN _body b USING (msg_id)
)
""" + "\nUNION ALL ".join(_filter_sql(n, f) for n, f in MAIL_FILTERS.items()))
def q_mail_filter(t: Tables) -> DataFrame:
    """#21: structured message filters (spam/trash hidden unless asked)."""
    pm = parsed_messages(t)
    names = F.array(*[F.when(M.mail_condition(MAIL_AS_OF, **f), F.lit(n)) for n, f in MAIL_FILTERS.items()])
    return (pm.select("msg_id", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("filter_name"))
              .select("filter_name", "msg_id"))


# --------------------------------------------------------------- calendar

def event_json(t: Tables) -> DataFrame:
    """Calendar event JSON per ``events`` row (all-day for signups, a broken
    start time for some errors, 0-2 attendees)."""
    e = t.events
    ts = F.col("ts")
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    allday = F.col("event_type") == "signup"
    bad = (F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)
    end_local = ts + F.make_interval(mins=F.floor(F.col("value")).cast("int")) + F.expr("INTERVAL 2 HOURS")
    start = F.when(allday, F.struct(F.lit(None).cast("string").alias("dateTime"),
                                    F.date_format(ts, "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("timeZone"))) \
             .otherwise(F.struct(F.when(bad, F.lit("not-a-date")).otherwise(F.concat(iso(ts), F.lit("Z"))).alias("dateTime"),
                                 F.lit(None).cast("string").alias("date"), F.lit("UTC").alias("timeZone")))
    end = F.when(allday, F.struct(F.lit(None).cast("string").alias("dateTime"),
                                  F.date_format(F.date_add(ts, 1), "yyyy-MM-dd").alias("date"),
                                  F.lit(None).cast("string").alias("timeZone"))) \
           .otherwise(F.struct(F.concat(iso(end_local), F.lit("+02:00")).alias("dateTime"),
                               F.lit(None).cast("string").alias("date"), F.lit("Europe/Paris").alias("timeZone")))
    att1 = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
                    F.lit("accepted").alias("responseStatus"), F.lit(None).cast("boolean").alias("optional"))
    att2 = F.struct(F.lit("x@example.com").alias("email"), F.lit("needsAction").alias("responseStatus"),
                    F.lit(True).alias("optional"))
    att = (F.when(F.col("user_id") % 3 == 0, F.array().cast("array<struct<email:string,responseStatus:string,optional:boolean>>"))
            .when(F.col("user_id") % 3 == 1, F.array(att1)).otherwise(F.array(att1, att2)))
    body = F.struct(F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"),
                    F.when(F.col("event_type") == "error", F.lit("cancelled")).otherwise(F.lit("confirmed")).alias("status"),
                    F.lit("2023-12-31T00:00:00Z").alias("created"),
                    F.concat(iso(ts + F.expr("INTERVAL 1 DAY")), F.lit("Z")).alias("updated"),
                    F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("summary"),
                    start.alias("start"), end.alias("end"), att.alias("attendees"))
    return e.select("event_id", F.to_json(body).alias("raw"))


def parsed_events(t: Tables) -> DataFrame:
    p = event_json(t).select("event_id", M.parse_event(F.col("raw")).alias("e"))
    return p.select("event_id", F.col("e.id").alias("id"), F.col("e.status").alias("status"),
                    F.col("e.summary").alias("summary"), F.col("e.start.dateTime").alias("start_ts"),
                    F.col("e.start.date").alias("start_date"), F.col("e.end.dateTime").alias("end_ts"),
                    F.col("e.updated").alias("updated_ts"), F.size("e.attendees").alias("_na"),
                    F.col("e.attendees").isNull().alias("_noatt"))


EV_SQL = """_ev AS (
  SELECT event_id, 'ev' || CAST(event_id AS VARCHAR) AS id,
         CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'confirmed' END AS status,
         event_type || ' by user ' || CAST(user_id AS VARCHAR) AS summary,
         CASE WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 4 = 0) THEN NULL
              ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS start_ts,
         CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END AS start_date,
         CASE WHEN event_type = 'signup' THEN NULL
              ELSE date_trunc('second', ts) + to_minutes(CAST(floor(value) AS BIGINT)) END AS end_ts,
         date_trunc('second', ts) + INTERVAL 1 DAY AS updated_ts,
         CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END AS n_attendees
  FROM events
)"""


@register("parse_event", sql=f"""
WITH {EV_SQL}
SELECT event_id, id, status, summary, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_utc,
       strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_utc,
       CAST(n_attendees AS INTEGER) AS n_attendees
FROM _ev""")
def q_parse_event(t: Tables) -> DataFrame:
    """#87: event JSON -> typed fields; Z and offsets to UTC; bad times null."""
    p = parsed_events(t)
    return p.select("event_id", "id", "status", "summary",
                    F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_utc"),
                    F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
                    F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("end_utc"),
                    F.when(~F.col("_noatt"), F.col("_na")).cast("int").alias("n_attendees"))


SEARCHES = {
    "by_id": dict(event_id="ev42"),
    "query_bounded": dict(query="purchase", start="2024-01-03 00:00:00"),
    "range_by_updated": dict(start="2024-01-02 00:00:00", end="2024-01-04 00:00:00", order_by="updated"),
}


@register("event_search", sql=f"""
WITH {EV_SQL}
SELECT 'by_id' AS search, id, CAST(1 AS BIGINT) AS pos FROM _ev WHERE id = 'ev42'
UNION ALL
SELECT 'query_bounded', id, row_number() OVER (ORDER BY start_ts, id) FROM (
  SELECT * FROM _ev WHERE contains(lower(summary), 'purchase') AND start_ts >= TIMESTAMP '2024-01-03 00:00:00'
  ORDER BY start_ts, id LIMIT {A.DEFAULT_EVENT_LIMIT_QUERY})
UNION ALL
SELECT 'range_by_updated', id, row_number() OVER (ORDER BY updated_ts, id) FROM (
  SELECT * FROM _ev WHERE start_ts >= TIMESTAMP '2024-01-02 00:00:00' AND start_ts <= TIMESTAMP '2024-01-04 00:00:00'
  ORDER BY updated_ts, id LIMIT {A.DEFAULT_EVENT_LIMIT_RANGE})""")
def q_event_search(t: Tables) -> DataFrame:
    """#22: by id / text query with bound / range ordered by updated (default limits)."""
    ev = parsed_events(t)
    out = None
    for name, kw in SEARCHES.items():
        part = A.event_search(ev, **kw).select(F.lit(name).alias("search"), "id", F.col("pos").cast("long").alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


@register("normalize_bound", sql="""
SELECT event_id,
  strftime(CASE event_id % 3
    WHEN 0 THEN CAST(date_trunc('second', ts) AS TIMESTAMP)
    WHEN 1 THEN date_trunc('second', ts) - INTERVAL 5 HOUR
    ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS text_bound,
  strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '23:59:59.999999', '%Y-%m-%d %H:%M:%S.%f') AS date_end_bound,
  strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS date_start_bound
FROM events""")
def q_normalize_bound(t: Tables) -> DataFrame:
    """#88: text bounds (Z / offset / naive) and date bounds (start of day, end of day)."""
    e = t.events
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z")))
             .when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("+05:00"))).otherwise(iso))
    d = F.to_date("ts")
    return e.select("event_id",
                    F.date_format(A.normalize_bound(text=text), "yyyy-MM-dd HH:mm:ss").alias("text_bound"),
                    F.date_format(A.normalize_bound(date=d, end=True), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date_end_bound"),
                    F.date_format(A.normalize_bound(date=d), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date_start_bound"))


# ------------------------------------------------------------ transcripts

def captions(t: Tables) -> DataFrame:
    """SRT text per document: 8 words per caption on two lines; the last
    caption has no trailing blank line (so a parser drops it)."""
    d = t.documents.select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))

    def ts(secs):
        ms = F.round(secs * 1000).cast("long")
        return F.format_string("%02d:%02d:%02d,%03d", (ms / 3600000).cast("long"), ((ms / 60000) % 60).cast("long"),
                               ((ms / 1000) % 60).cast("long"), ms % 1000)

    def block(i):
        start = i * 2.0 + (i % 3) * 0.25
        return F.concat((i + 1).cast("string"), F.lit("\n"), ts(start), F.lit(" --> "), ts(start + 1.75), F.lit("\n"),
                        F.array_join(F.slice("w", i * 8 + 1, 4), " "), F.lit("\n"),
                        F.array_join(F.slice("w", i * 8 + 5, 4), " "))
    n = F.ceil(F.size("w") / 8.0).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), block)
    return d.filter(F.size("w") > 0).select("doc_id", F.array_join(blocks, "\n\n").alias("srt"))


CAPTIONS_SQL = """_w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
_b AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 8.0) AS BIGINT))) AS i FROM _w WHERE len(w) > 0),
_blk AS (SELECT doc_id, i, i * 2.0 + (i % 3) * 0.25 AS s, w FROM _b),
_cap AS (SELECT doc_id, i, CAST(round(s * 1000) AS BIGINT) AS ms, CAST(round((s + 1.75) * 1000) AS BIGINT) AS me,
                array_to_string(w[i * 8 + 1: i * 8 + 4], ' ') || chr(10) || array_to_string(w[i * 8 + 5: i * 8 + 8], ' ') AS txt,
                len(w) AS nw FROM _blk),
_ent AS (  -- what the parser keeps: every caption but the last of a document
  SELECT doc_id, i AS pos, ms / 1000.0 AS start, round((me - ms) / 1000.0, 3) AS duration,
         regexp_replace(regexp_replace(txt, '^\\s+|\\s+$', '', 'g'), '\\r\\n|[\\n\\r]', ' ', 'g') AS text
  FROM _cap WHERE i < CAST(ceil(nw / 8.0) AS BIGINT) - 1
)"""


def transcript_entries(t: Tables) -> DataFrame:
    c = captions(t).select("doc_id", M.parse_srt(F.col("srt")).alias("e"))
    # posexplode_outer: no inferred size(e) > 0 filter re-evaluating the parse
    x = c.select("doc_id", F.posexplode_outer("e").alias("pos", "x")).filter(F.col("x").isNotNull())
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), "x.start", "x.duration", "x.text")


@register("parse_srt", sql=f"""
WITH {CAPTIONS_SQL}
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(start AS DOUBLE) AS start, CAST(duration AS DOUBLE) AS duration, text
FROM _ent""")
def q_parse_srt(t: Tables) -> DataFrame:
    """#91: SRT blocks -> (text, start, duration); the unterminated last block is lost."""
    return transcript_entries(t)


@register("transcript_markdown", sql=f"""
WITH {CAPTIONS_SQL},
md AS (
  SELECT d.doc_id, '# YouTube Video Transcript: v' || CAST(d.doc_id AS VARCHAR) || chr(10) || chr(10)
         || '**Video URL**: [https://www.youtube.com/watch?v=v' || CAST(d.doc_id AS VARCHAR)
         || '](https://www.youtube.com/watch?v=v' || CAST(d.doc_id AS VARCHAR) || ')' || chr(10) || chr(10)
         || '**Video ID**: v' || CAST(d.doc_id AS VARCHAR) || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10)
         || coalesce(string_agg('**[' || printf('%02d:%02d', CAST(floor(e.start / 60) AS BIGINT), CAST(floor(e.start % 60) AS BIGINT))
                               || ']** ' || e.text || chr(10) || chr(10), '' ORDER BY e.pos), '') AS markdown
  FROM (SELECT DISTINCT doc_id FROM _cap) d LEFT JOIN _ent e USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, CAST(length(markdown) AS BIGINT) AS n_chars, md5(markdown) AS markdown_md5 FROM md""")
def q_transcript_markdown(t: Tables) -> DataFrame:
    """#93: markdown transcript per video with [MM:SS] stamps."""
    c = captions(t).select("doc_id", M.parse_srt(F.col("srt")).alias("e"))
    vid = F.concat(F.lit("v"), F.col("doc_id").cast("string"))
    md = c.select("doc_id", M.transcript_markdown(F.col("e"), vid).alias("markdown"))
    return md.select("doc_id", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("markdown_md5"))


@register("mmss", sql="""
SELECT event_id, printf('%02d:%02d', CAST(floor(value * 100 / 60) AS BIGINT), CAST(floor((value * 100) % 60) AS BIGINT)) AS mmss
FROM events""")
def q_mmss(t: Tables) -> DataFrame:
    """#92: seconds -> MM:SS with unbounded minutes (value x 100 s)."""
    return t.events.select("event_id", M.mmss(F.col("value") * 100).alias("mmss"))


TRACE = ("'java.lang.IllegalStateException: ' || replace(text, chr(10), ' ') || chr(10) || chr(9) "
         "|| 'at com.example.Service.run(Service.java:' || CAST(doc_id AS STRING) || ')' || chr(10) || chr(9) "
         "|| 'at com.example.Main.main(Main.java:7)'")


@register("error_line", sql=f"""
SELECT doc_id, split_part({TRACE.replace('AS STRING', 'AS VARCHAR')}, chr(10), 1) AS search_text, lower(upper(lang)) AS tag
FROM documents""")
def q_error_line(t: Tables) -> DataFrame:
    """#95: first line of a stack trace is the search text; tag lower-cased."""
    d = t.documents.select("doc_id", F.expr(TRACE).alias("trace"), F.upper("lang").alias("lang_tag"))
    return d.select("doc_id", M.error_line(F.col("trace")).alias("search_text"), F.lower("lang_tag").alias("tag"))
