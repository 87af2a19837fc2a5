"""Chunking, cleaning, transcripts, mail parts (literal rows and small folds)."""

import base64
import math
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpuskit.functions.text import clean_document, collapse_whitespace
from corpuskit.operators import mail as M
from corpuskit.operators import prepare as P


def _py_chunks(text, size=400, overlap=40):
    units = text.split(" ")
    units = [u + " " for u in units[:-1]] + units[-1:]
    step, out, i = size - overlap, [], 0
    n = 1 if len(units) <= size else math.ceil((len(units) - size) / step) + 1
    for k in range(n):
        out.append("".join(units[k * step:k * step + size]))
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "c\nd", "", "e\f"]), min_size=1, max_size=30))
def test_chunks_match_python(spark, words):
    text = " ".join(words)
    df = spark.createDataFrame([(1, "f", text)], "doc_id long, source_filename string, text string")
    got = [r.content for r in P.chunk_document(df, "source_filename", "text", size=5, overlap=2)
           .orderBy("chunk_index").collect()]
    assert got == _py_chunks(text, 5, 2)


def test_whitespace_and_clean(spark):
    df = spark.createDataFrame([("a\n\n\n\nb  \t c",), ("  x \n\n  \n y  \fz  ",)], "t string")
    got = [r.c for r in df.select(collapse_whitespace("t").alias("c")).collect()]
    assert got == ["a\n\nb c", " x \n\n \n y \fz "]
    got = [r.c for r in df.select(clean_document("t").alias("c")).collect()]
    assert got == ["a\nb c", "x y\fz"]


def test_mmss(spark):
    cases = {0.0: "00:00", 30.0: "00:30", 60.0: "01:00", 90.0: "01:30", 3600.0: "60:00"}
    df = spark.createDataFrame([(s,) for s in cases], "s double")
    assert {r.s: r.m for r in df.select("s", M.mmss(F.col("s")).alias("m")).collect()} == cases


def _py_srt(srt):
    pat = re.compile(r"\d+\n(\d{2}:\d{2}:\d{2},\d{3}) --> (\d{2}:\d{2}:\d{2},\d{3})\n([\s\S]*?)\n\n", re.MULTILINE)

    def sec(t):
        h, m, sm = t.split(":")
        s, ms = sm.split(",")
        return int(h) * 3600 + int(m) * 60 + int(s) + int(ms) / 1000.0
    return [(" ".join(x.strip().splitlines()), sec(a), round(sec(b) - sec(a), 3)) for a, b, x in pat.findall(srt)]


def test_srt_matches_python(spark):
    srt = ("1\n00:00:00,000 --> 00:00:01,500\nHello\nworld\n\n2\n00:00:02,250 --> 00:00:04,000\n second \n\n"
           "3\n00:01:00,000 --> 00:01:02,000\nlast block has no blank line")
    got = spark.createDataFrame([(srt,)], "s string").select(M.parse_srt(F.col("s")).alias("e")).first().e
    assert [(e.text, e.start, e.duration) for e in got] == _py_srt(srt)


def test_srt_blocks_are_cut_by_place(spark, capsys):
    """Odd blocks as the regex reads them; no regex per field and block (13 before, 260 us a caption)."""
    srt = ("0012\n00:00:00,000 --> 00:00:01,500\n\n\n7\n10:59:59,999 --> 11:00:00,001\n  ä€𝄞 \r\n b\rc \n\n\n"
           "no block\n\n8\n00:00:02,250 -> 00:00:04,000\nbad arrow\n\n99\n1\n00:00:05,000 --> 00:00:04,000\n3\n4\n\n")
    df = spark.createDataFrame([(1, srt), (2, ""), (3, None)], "id int, s string")
    out = df.select("id", M.parse_srt(F.col("s")).alias("e"))
    got = {r.id: r.e for r in out.collect()}
    assert [(e.text, e.start, e.duration) for e in got[1]] == [
        ("", 0.0, 1.5), ("ä€𝄞   b c", 39599.999, 0.002), ("3 4", 5.0, -1.0)]
    assert got[2] == [] and got[3] is None
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "regexp_extract(" not in plan and plan.count("regexp_extract_all(") == 1


def test_plain_body_rules(spark):
    b = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    rows = [
        (1, [], "multipart/mixed", [], None),
        (1, [0], "multipart/alternative", ["multipart/mixed"], None),
        (1, [0, 0], "text/html", ["multipart/mixed", "multipart/alternative"], b("<p>x</p>")),
        (1, [0, 1], "text/plain", ["multipart/mixed", "multipart/alternative"], b("plain one")),
        (2, [], "multipart/alternative", [], None),
        (2, [0], "multipart/mixed", ["multipart/alternative"], None),
        (2, [0, 0], "text/plain", ["multipart/alternative", "multipart/mixed"], b("unreachable")),
        (3, [], "text/plain", [], "__54"),
    ]
    df = spark.createDataFrame(rows, "msg_id long, path array<int>, mime string, ancestors array<string>, data string")
    got = {r.msg_id: r.plain_text_body for r in M.plain_body(df).collect()}
    assert got == {1: "plain one", 2: None, 3: None}


def test_header_rules(spark):
    hdr = [("Subject", "first"), ("subject", "second"), ("From", "Ann <ann.b@x.org>"),
           ("To", "a@x.org, b@y.org"), ("Cc", "a@x.org"), ("Date", "Tue, 18 Jul 2023 10:30:00 -0700 (PDT)")]
    df = spark.createDataFrame([(1, [{"name": n, "value": v} for n, v in hdr], "1689700000000")],
                               "msg_id long, headers array<struct<name:string,value:string>>, internal_ms string")
    r = M.parse_message(df).first()
    assert r.subject == "first" and r.sender_email == "ann.b@x.org"
    assert r.recipient_emails == ["a@x.org", "b@y.org"]
    assert str(r.sent_date) == "2023-07-18 17:30:00"


def test_event_json_is_parsed_once(spark, capsys):
    raw = ('{"id":"e1","status":"confirmed","summary":"s","created":"2024-01-01T00:00:00Z","updated":"2024-01-02T10:00Z",'
           '"start":{"dateTime":"2024-01-03T10:00:00+02:00"},"end":{"date":"2024-01-04"},"attendees":[{"email":"a@x.y"}]}')
    df = spark.createDataFrame([(1, raw), (2, '{"id":"e2","start":{"dateTime":"no"},"attendees":[]}'), (3, "no json"), (4, None)], "k int, raw string")
    out = df.select("k", M.parse_event(F.col("raw")).alias("e")).select(
        "k", "e.id", "e.status", F.col("e.start.dateTime").cast("string").alias("s"), F.col("e.end.date").cast("string").alias("d"),
        F.col("e.updated").cast("string").alias("u"), F.size("e.attendees").alias("n"), F.col("e.start").isNull().alias("no_start"))
    null = None
    assert [tuple(r) for r in out.orderBy("k").collect()] == [
        (1, "e1", "confirmed", "2024-01-03 08:00:00", "2024-01-04", "2024-01-02 10:00:00", 1, False),
        (2, "e2", null, null, null, null, null, False),
        (3, null, null, null, null, null, null, True), (4, null, null, null, null, null, null, True)]
    out.explain("simple")
    assert capsys.readouterr().out.count("from_json(") == 1
