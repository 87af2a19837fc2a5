"""Mail, calendar and transcript functions (#21, #59, #87-93, #95).

The MIME part tree is flat rows ``(msg_id, path array<int>, mime,
ancestors array<string>, data)`` - Spark structs cannot recurse, so readers
flatten the tree once, with the path giving depth-first order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.activity import iso_timestamp

# --- fixed values ------------------------------------------------------------
EMAIL_RE = r"[\w\.-]+@[\w\.-]+"
TZ_NAME_TAIL = r"\s*\([A-Z]+\)$"
WEEKDAY_HEAD = r"^[A-Za-z]{3}, "
# Date header formats tried in order (weekday stripped first).
DATE_FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssZ"]
HIDDEN_LABELS = ["SPAM", "TRASH"]
SRT_BLOCK_RE = r"\d+\n(\d{2}:\d{2}:\d{2},\d{3}) --> (\d{2}:\d{2}:\d{2},\d{3})\n([\s\S]*?)\n\n"
# -----------------------------------------------------------------------------


def header(headers: Column, name: str) -> Column:
    """First header value whose name matches case-insensitively."""
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(hit, F.lit(1))["value"]


def first_email(value: Column) -> Column:
    return F.when(value.rlike(EMAIL_RE), F.regexp_extract(value, EMAIL_RE, 0))


def recipients(headers: Column, names: tuple[str, ...] = ("To", "Cc")) -> Column:
    """#59: unique addresses over the given headers, sorted."""
    found = [F.coalesce(F.regexp_extract_all(F.coalesce(header(headers, n), F.lit("")), F.lit(EMAIL_RE), 0),
                        F.array().cast("array<string>")) for n in names]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def header_date(value: Column) -> Column:
    """Date header -> UTC timestamp (4 formats, ``(PDT)`` tail dropped, naive = UTC)."""
    v = F.regexp_replace(F.trim(value), TZ_NAME_TAIL, "")
    no_wd = F.regexp_replace(v, WEEKDAY_HEAD, "")
    return F.coalesce(F.try_to_timestamp(no_wd, F.lit(DATE_FORMATS[0])),
                      F.try_to_timestamp(no_wd, F.lit(DATE_FORMATS[1])),
                      F.try_to_timestamp(v, F.lit(DATE_FORMATS[2])))


def parse_message(msgs: DataFrame, headers: str = "headers", internal_ms: str = "internal_ms") -> DataFrame:
    """#89: subject, sender, recipients, sent date, internal date."""
    h = F.col(headers)
    return msgs.select(
        "*", header(h, "Subject").alias("subject"), first_email(header(h, "From")).alias("sender_email"),
        recipients(h).alias("recipient_emails"), header_date(header(h, "Date")).alias("sent_date"),
        F.timestamp_millis(F.col(internal_ms).cast("long")).alias("internal_date"))


def decode_b64url(data: Column) -> Column:
    """base64url -> UTF-8 text; undecodable -> null."""
    raw = F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64"))
    s = raw.cast("string")
    return F.when(F.is_valid_utf8(s), s)


def plain_body(parts: DataFrame, msg: str = "msg_id") -> DataFrame:
    """#90: first (depth-first) text/plain part with a non-empty decoded body.

    A part is reachable when every ancestor is multipart, and a
    multipart/alternative ancestor is only allowed as the direct parent
    (alternatives are searched one level deep only)."""
    anc = F.col("ancestors")
    reachable = (F.forall(anc, lambda a: a.startswith("multipart/"))
                 & ~F.array_contains(F.slice(anc, 1, F.greatest(F.size(anc) - 1, F.lit(0))),
                                     "multipart/alternative"))
    body = decode_b64url(F.col("data"))
    ok = (F.col("mime") == "text/plain") & reachable & body.isNotNull() & (F.length(body) > 0)
    c = parts.withColumn("_body", body).withColumn("_ok", ok)
    return c.groupBy(msg).agg(F.expr("min_by(_body, path) FILTER (WHERE _ok)").alias("plain_text_body"))


def mail_filter(msgs: DataFrame, as_of: str, sender: str | None = None, recipient: str | None = None,
                subject: str | None = None, has_attachment: bool | None = None, newer_than_days: int | None = None,
                older_than_days: int | None = None, after: str | None = None, before: str | None = None,
                labels: list[str] | None = None, unread: bool | None = None, phrase: str | None = None,
                any_of: list[str] | None = None, all_of: list[str] | None = None, exclude: str | None = None,
                include_spam_trash: bool = False) -> DataFrame:
    """#21: structured filter over parsed messages (columns from
    ``parse_message`` plus ``labels``, ``body``, ``has_attachment``)."""
    return msgs.filter(mail_condition(as_of, sender, recipient, subject, has_attachment, newer_than_days,
                                      older_than_days, after, before, labels, unread, phrase, any_of, all_of,
                                      exclude, include_spam_trash))


def mail_condition(as_of: str, sender: str | None = None, recipient: str | None = None, subject: str | None = None,
                   has_attachment: bool | None = None, newer_than_days: int | None = None,
                   older_than_days: int | None = None, after: str | None = None, before: str | None = None,
                   labels: list[str] | None = None, unread: bool | None = None, phrase: str | None = None,
                   any_of: list[str] | None = None, all_of: list[str] | None = None, exclude: str | None = None,
                   include_spam_trash: bool = False) -> Column:
    """The #21 filter as one boolean Column (so many filters share one scan)."""
    c = F.lit(True)
    low = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    text = F.concat_ws(" ", low("subject"), low("body"))
    if sender:
        c = c & low("sender_email").contains(sender.lower())
    if recipient:
        c = c & F.exists("recipient_emails", lambda r: F.lower(r).contains(recipient.lower()))
    if subject:
        c = c & low("subject").contains(subject.lower())
    if has_attachment is not None:
        c = c & (F.col("has_attachment") == has_attachment)
    ref = F.lit(as_of).cast("timestamp")
    if newer_than_days is not None:
        c = c & (F.col("internal_date") >= ref - F.make_interval(days=F.lit(newer_than_days)))
    if older_than_days is not None:
        c = c & (F.col("internal_date") < ref - F.make_interval(days=F.lit(older_than_days)))
    if after:
        c = c & (F.col("internal_date") >= F.lit(after).cast("timestamp"))
    if before:
        c = c & (F.col("internal_date") < F.lit(before).cast("timestamp"))
    for lab in labels or []:
        c = c & F.array_contains("labels", lab)
    if unread is not None:
        c = c & (F.array_contains("labels", "UNREAD") == unread)
    if phrase:
        c = c & text.contains(phrase.lower())
    if any_of:
        anyc = F.lit(False)
        for w in any_of:
            anyc = anyc | text.contains(w.lower())
        c = c & anyc
    for w in all_of or []:
        c = c & text.contains(w.lower())
    if exclude:
        c = c & ~text.contains(exclude.lower())
    if not include_spam_trash:
        c = c & ~F.arrays_overlap("labels", F.array(*[F.lit(x) for x in HIDDEN_LABELS]))
    return c


# -------------------------------------------------------------- calendar

def parse_iso(c: Column) -> Column:
    """ISO-8601 text; trailing Z = UTC; naive = UTC; unparsable -> null."""
    return iso_timestamp(c)


EVENT_SCHEMA = (
    "struct<id:string,status:string,htmlLink:string,created:string,updated:string,summary:string,"
    "description:string,location:string,creator:struct<email:string,displayName:string,self:boolean>,"
    "organizer:struct<email:string,displayName:string,self:boolean>,"
    "start:struct<dateTime:string,date:string,timeZone:string>,end:struct<dateTime:string,date:string,timeZone:string>,"
    "attendees:array<struct<email:string,displayName:string,organizer:boolean,self:boolean,resource:boolean,"
    "optional:boolean,responseStatus:string,comment:string,additionalGuests:int>>,"
    "hangoutLink:string,recurringEventId:string>")


def parse_event(raw: Column) -> Column:
    """#87: event JSON -> typed struct (times to UTC, dates as DATE,
    attendees null when empty)."""
    def when_dt(part):
        return F.struct(parse_iso(F.nullif(part["dateTime"], F.lit(""))).alias("dateTime"),
                        F.try_to_date(F.nullif(part["date"], F.lit("")), "yyyy-MM-dd").alias("date"),
                        part["timeZone"].alias("timeZone"))

    def typed(e):
        att = F.when(F.size(F.coalesce(e["attendees"], F.array())) > 0, e["attendees"])
        return F.struct(e["id"].alias("id"), e["status"].alias("status"), e["summary"].alias("summary"),
                        parse_iso(e["created"]).alias("created"), parse_iso(e["updated"]).alias("updated"),
                        F.when(e["start"].isNotNull(), when_dt(e["start"])).alias("start"),
                        F.when(e["end"].isNotNull(), when_dt(e["end"])).alias("end"),
                        att.alias("attendees"))

    # bound to a lambda variable: written out, the JSON would be parsed again for every field that is read
    return F.transform(F.array(F.from_json(raw, EVENT_SCHEMA)), typed)[0]


# ------------------------------------------------------------- transcripts

def parse_srt(srt: Column) -> Column:
    """#91: array<struct<text, start, duration>>; blocks need a trailing blank line.

    One regex pass collects whole blocks, so the caption text is scanned once. A
    block is digits, a line feed, a time line of fixed width and the text: its
    parts are cut out by their places, no regex runs again over a block."""
    blocks = F.regexp_extract_all(srt, F.lit(SRT_BLOCK_RE), 0)

    def entry(b):
        at = F.instr(b, "\n")  # the time line follows: two times of 12 characters, 5 between them

        def number(first: int, n: int):
            return F.substring(b, at + first, F.lit(n)).cast("int")

        def secs(first: int):
            return (number(first, 2) * 3600 + number(first + 3, 2) * 60 + number(first + 6, 2)) + number(first + 9, 3) / 1000.0

        t = F.substring(b, at + 31, F.length(b) - at - 32)
        return F.struct(F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\r\n|[\n\r]", " ").alias("text"),
                        secs(1).alias("start"), F.round(secs(18) - secs(1), 3).alias("duration"))
    return F.transform(blocks, entry)


def mmss(seconds: Column) -> Column:
    """#92: seconds -> MM:SS, minutes unbounded."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), F.floor(seconds % 60).cast("long"))


def transcript_header(video_id: Column, url: Column | None = None) -> Column:
    u = F.coalesce(url, F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)) if url is not None else \
        F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)
    return F.concat(F.lit("# YouTube Video Transcript: "), video_id, F.lit("\n\n**Video URL**: ["), u, F.lit("]("), u,
                    F.lit(")\n\n**Video ID**: "), video_id, F.lit("\n\n## Transcript\n\n"))


def transcript_markdown(entries: Column, video_id: Column) -> Column:
    """#93: header + ``**[MM:SS]** text`` per entry, in order."""
    lines = F.transform(entries, lambda e: F.concat(F.lit("**["), mmss(e["start"]), F.lit("]** "), e["text"],
                                                    F.lit("\n\n")))
    return F.concat(transcript_header(video_id), F.array_join(lines, ""))


def error_line(trace: Column) -> Column:
    """#95: first line of a stack trace is the search text."""
    return F.split_part(trace, F.lit("\n"), F.lit(1))
