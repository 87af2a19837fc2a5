"""Q&A threads, issues, logs, problems, quotas, streaks and conversations
(#23, #53, #55, #58, #63, #66-70, #94, #96-97).

Threads: ``orders`` as questions, ``lineitem`` as answers, ``customer`` as
owners. Logs: ``events`` (error = failure). Issues and agent streams:
``conversations``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import html_to_text
from corpuskit.operators import activity as A
from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import html_to_text_sql, sql_str
from corpuskit.sources import fixtures as X
from corpuskit.tables import Tables

# Shared expressions (Spark SQL and DuckDB read them the same way).
Q_SCORE = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 50000) AS INT) - 3 END"
Q_TAGS = "[lower(o_orderstatus), lower(split_part(o_orderpriority, '-', 2))]"
A_SCORE = "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS INT) - 25 END"


def questions(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    return o.select(F.col("o_orderkey").alias("question_id"),
                    F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
                    F.expr(Q_SCORE).alias("score"),
                    F.array(F.lower("o_orderstatus"), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))))
                     .alias("tags"),
                    F.concat(F.lit("Status "), F.col("o_orderstatus"), F.lit(", priority "), F.col("o_orderpriority"))
                     .alias("body"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("creation_date"),
                    "o_orderdate", F.col("c_name").alias("owner"),
                    F.concat(F.lit("https://stackoverflow.com/q/"), F.col("o_orderkey").cast("string")).alias("link"))


def answers(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer_id"),
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("seq"),
        F.expr(A_SCORE).alias("score"), (F.col("l_returnflag") == "A").alias("is_accepted"),
        F.concat(F.lit("Use part "), F.col("l_partkey").cast("string")).alias("body"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("creation_date"),
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("owner"))


ANSWERS_SQL = f"""_ans AS (
  SELECT l_orderkey * 10 + l_linenumber AS answer_id, l_orderkey AS question_id, l_linenumber AS seq,
         {A_SCORE} AS score, l_returnflag = 'A' AS is_accepted, 'Use part ' || CAST(l_partkey AS VARCHAR) AS body,
         strftime(l_shipdate, '%Y-%m-%d') AS creation_date, 'Supplier#' || CAST(l_suppkey AS VARCHAR) AS owner
  FROM lineitem)"""


@register("sort_answers", sql=f"""
WITH {ANSWERS_SQL}
SELECT question_id, answer_id,
       CAST(row_number() OVER (PARTITION BY question_id ORDER BY coalesce(score, 0) DESC, seq) AS INTEGER) AS answer_pos
FROM _ans""")
def q_sort_answers(t: Tables) -> DataFrame:
    """#63: answers by score desc (missing 0), stable."""
    return A.sort_answers(answers(t), "question_id", "score", "seq").select("question_id", "answer_id", "answer_pos")


@register("nest_thread", sql=f"""
WITH {ANSWERS_SQL}
SELECT o.o_orderkey AS question_id, CAST(count(a.answer_id) AS BIGINT) AS n_answers,
       coalesce(string_agg(CAST(a.answer_id AS VARCHAR), ',' ORDER BY coalesce(a.score, 0) DESC, a.seq, a.answer_id, a.score ASC NULLS FIRST, a.is_accepted, a.body, a.owner, a.creation_date), '') AS answer_ids,
       coalesce(string_agg(CASE WHEN a.is_accepted THEN CAST(a.answer_id AS VARCHAR) END, ','
                           ORDER BY coalesce(a.score, 0) DESC, a.seq, a.answer_id, a.score ASC NULLS FIRST, a.is_accepted, a.body, a.owner, a.creation_date), '') AS accepted_ids
FROM orders o LEFT JOIN _ans a ON a.question_id = o.o_orderkey
GROUP BY o.o_orderkey""")
def q_nest_thread(t: Tables) -> DataFrame:
    """#53: question + its answers ordered by votes; questions without answers kept."""
    from corpuskit.operators import threads as TH
    n = TH.nest_thread(questions(t), answers(t))
    return n.select("question_id", "n_answers",
                    F.array_join(F.transform("answers", lambda a: a["answer_id"].cast("string")), ",").alias("answer_ids"),
                    F.array_join(F.transform(F.filter("answers", lambda a: a["is_accepted"]),
                                             lambda a: a["answer_id"].cast("string")), ",").alias("accepted_ids"))


def _md_sql() -> str:
    head = ("'# ' || q.title || chr(10) || chr(10) || '**Score**: ' || CAST(coalesce(q.score, 0) AS VARCHAR) || ' | ' "
            "|| '**Asked by**: ' || coalesce(q.owner, 'Anonymous') || ' | ' || '**Date**: ' || q.creation_date "
            "|| chr(10) || chr(10) || q.body || chr(10) || chr(10) || '---' || chr(10) || chr(10) "
            "|| '## ' || CAST(count(a.answer_id) AS VARCHAR) || ' Answers' || chr(10) || chr(10)")
    ans = ("'### Answer ' || CAST(a.pos AS VARCHAR) || ' (Score: ' || CAST(coalesce(a.score, 0) AS VARCHAR) || ')' "
           "|| chr(10) || chr(10) || '**Answered by**: ' || coalesce(a.owner, 'Anonymous') || ' | ' || '**Date**: ' "
           "|| a.creation_date || chr(10) || chr(10) || a.body || chr(10) || chr(10) || '---' || chr(10) || chr(10)")
    return f"""
WITH {ANSWERS_SQL},
_q AS (SELECT o_orderkey AS question_id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, {Q_SCORE} AS score,
              'Status ' || o_orderstatus || ', priority ' || o_orderpriority AS body,
              strftime(o_orderdate, '%Y-%m-%d') AS creation_date, c.c_name AS owner
       FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey),
_a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(score, 0) DESC, seq, answer_id, score ASC NULLS FIRST, is_accepted, body, owner, creation_date) AS pos FROM _ans),
md AS (SELECT q.question_id, {head} || coalesce(string_agg({ans}, '' ORDER BY a.pos), '') AS markdown
       FROM _q q LEFT JOIN _a a USING (question_id)
       GROUP BY q.question_id, q.title, q.score, q.owner, q.creation_date, q.body)
SELECT question_id, CAST(length(markdown) AS BIGINT) AS n_chars, md5(markdown) AS markdown_md5 FROM md"""


@register("thread_markdown", sql=_md_sql())
def q_thread_markdown(t: Tables) -> DataFrame:
    """#94: page-view rendering of each thread (answers by score)."""
    from corpuskit.operators import threads as TH
    md = TH.thread_markdown(questions(t), answers(t))
    return md.select("question_id", F.length("markdown").cast("long").alias("n_chars"),
                     F.md5("markdown").alias("markdown_md5"))


C_SCORE = "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linenumber - 2 END"
C_ANSWER = "CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey * 10 + l_linenumber END"


def comments(t: Tables) -> DataFrame:
    """Every line is a comment: the even ones on their own answer, the odd ones on the question."""
    return t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.expr(C_ANSWER).alias("answer_id"),
                             F.col("l_linenumber").alias("seq"), F.expr(C_SCORE).alias("score"),
                             F.concat(F.lit("Line status "), F.col("l_linestatus"), F.lit(" of part "),
                                      F.col("l_partkey").cast("string")).alias("body"))


COMMENTS_SQL = f"""_com AS (
  SELECT l_orderkey AS question_id, {C_ANSWER} AS answer_id, l_linenumber AS seq, {C_SCORE} AS score,
         'Line status ' || l_linestatus || ' of part ' || CAST(l_partkey AS VARCHAR) AS body
  FROM lineitem),
_cp AS (SELECT *, row_number() OVER (PARTITION BY question_id, answer_id ORDER BY seq, body, score) AS pos FROM _com)"""

PLACED_SQL = f"""
_qn AS (SELECT o_orderkey AS question_id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, {Q_SCORE} AS score, {Q_TAGS} AS tags,
               'Status ' || o_orderstatus || ', priority ' || o_orderpriority AS body,
               strftime(o_orderdate, '%Y-%m-%d') AS creation_date,
               'https://stackoverflow.com/q/' || CAST(o_orderkey AS VARCHAR) AS link, coalesce(n, 0) AS n
        FROM orders LEFT JOIN (SELECT question_id, count(*) AS n FROM _ans GROUP BY question_id) ON question_id = o_orderkey),
_an AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(score, 0) DESC, seq, answer_id, body, owner,
               creation_date, is_accepted, score) AS part FROM _ans)"""
_NL = "chr(10)"


@register("thread_comments", sql=f"""
WITH {COMMENTS_SQL}
SELECT question_id, answer_id, pos, body, score FROM _cp""")
def q_thread_comments(t: Tables) -> DataFrame:
    """#53: the comments of each thread, in order under their answer or question."""
    from corpuskit.operators import threads as TH
    return TH.thread_comments(comments(t)).select("question_id", "answer_id", "pos", "body", "score")


@register("thread_search_markdown", sql=f"""
WITH {ANSWERS_SQL}, {COMMENTS_SQL}, {PLACED_SQL},
_line AS (SELECT *, '- ' || body || ' *(Score: ' || CAST(coalesce(score, 0) AS VARCHAR) || ')*' || {_NL} AS text FROM _cp),
_has AS (SELECT DISTINCT question_id FROM _com WHERE answer_id IS NULL),
u AS (
  SELECT q.question_id, 0 AS part, 0 AS sub, '# ' || title || {_NL} || {_NL} || '**Score:** ' || CAST(coalesce(score, 0) AS VARCHAR)
         || ' | **Answers:** ' || CAST(n AS VARCHAR) || {_NL} || {_NL} || '## Question' || {_NL} || {_NL} || body || {_NL} || {_NL}
         || CASE WHEN h.question_id IS NULL THEN '' ELSE '### Question Comments' || {_NL} || {_NL} END AS text
  FROM _qn q LEFT JOIN _has h USING (question_id)
  UNION ALL SELECT question_id, 0, pos, text FROM _line WHERE answer_id IS NULL
  UNION ALL SELECT q.question_id, 0, 2147483647, CASE WHEN h.question_id IS NULL THEN '' ELSE {_NL} END || '## Answers' || {_NL} || {_NL}
  FROM _qn q LEFT JOIN _has h USING (question_id)
  UNION ALL SELECT question_id, part, 0, '### ' || CASE WHEN is_accepted THEN '✓ ' ELSE '' END || 'Answer (Score: '
         || CAST(coalesce(score, 0) AS VARCHAR) || ')' || {_NL} || {_NL} || body || {_NL} || {_NL} || '#### Answer Comments' || {_NL} || {_NL}
  FROM _an
  UNION ALL SELECT a.question_id, a.part, l.pos, l.text FROM _an a JOIN _line l
    ON l.question_id = a.question_id AND l.answer_id = a.answer_id
  UNION ALL SELECT question_id, part, 2147483647, {_NL} FROM _an
  UNION ALL SELECT question_id, 2147483647, 0, '---' || {_NL} || {_NL} || '[View on Stack Overflow](' || link || ')' || {_NL} || {_NL} FROM _qn
)
SELECT question_id, CAST(part AS BIGINT) AS part, CAST(sub AS BIGINT) AS sub, text FROM u""")
def q_thread_search_markdown(t: Tables) -> DataFrame:
    """#94: search layout of each thread with accepted marks and comments, as ordered parts."""
    from corpuskit.operators import threads as TH
    return TH.thread_search_parts(questions(t), answers(t), comments(t))


def _tag_sql(name: str, value: str) -> str:
    return f"'<{name}>' || coalesce(CAST({value} AS VARCHAR), '') || '</{name}>' || {_NL}"


@register("context_threads", sql=f"""
WITH {ANSWERS_SQL}, {PLACED_SQL},
u AS (
  SELECT question_id, 0 AS part, '<question>' || {_NL} || {_tag_sql('title', 'title')} || {_tag_sql('score', 'score')}
         || {_tag_sql('answer_count', 'n')} || {_tag_sql('creation_date', 'creation_date')}
         || {_tag_sql('tags', "'[' || chr(39) || array_to_string(tags, chr(39) || ', ' || chr(39)) || chr(39) || ']'")} || {_tag_sql('url', 'link')}
         || {_tag_sql('question_id', 'question_id')} || '<question_body> ' || {_NL} || body || {_NL} || '</question_body>' || {_NL}
         || '<answers>' || {_NL} AS text FROM _qn
  UNION ALL SELECT question_id, part, {_NL} || '<answer>' || {_NL}
         || {_tag_sql('is_accepted', "CASE WHEN is_accepted THEN 'True' ELSE 'False' END")} || {_tag_sql('score', 'score')}
         || {_tag_sql('creation_date', 'creation_date')} || {_tag_sql('answer_id', 'answer_id')} || '<answer_body>' || {_NL} || body
         || {_NL} || '</answer_body>' || {_NL} || '</answer>' || {_NL} FROM _an
  UNION ALL SELECT question_id, 2147483647, {_NL} || '</answers>' || {_NL} || '</question>' FROM _qn
)
SELECT question_id, CAST(part AS BIGINT) AS part, text FROM u""")
def q_context_threads(t: Tables) -> DataFrame:
    """#47: question-and-answer context of each thread, as ordered parts."""
    from corpuskit.operators import threads as TH
    return TH.thread_context_parts(questions(t), answers(t)).select("question_id", "part", "text")


THREAD_TAGS, THREAD_LIMIT, THREAD_MIN = ["F", "URGENT"], 40, 1


@register("thread_filter", sql=f"""
WITH q AS (SELECT o_orderkey AS question_id, o_orderdate, {Q_SCORE} AS score, {Q_TAGS} AS tags FROM orders),
f AS (SELECT * FROM q WHERE list_contains(tags, 'f') AND list_contains(tags, 'urgent')
      ORDER BY o_orderdate DESC, question_id LIMIT {THREAD_LIMIT})
SELECT question_id, score FROM f WHERE coalesce(score, 0) >= {THREAD_MIN}""")
def q_thread_filter(t: Tables) -> DataFrame:
    """#23: tags AND (lower-cased), limit before min score, missing score = 0."""
    f = A.thread_filter(questions(t), THREAD_TAGS, THREAD_LIMIT, THREAD_MIN,
                        [F.col("o_orderdate").desc(), F.col("question_id")])
    return f.select("question_id", "score")


# ---------------------------------------------------------------- issues

@register("issue_thread", sql="""
SELECT conv_id, listagg(CASE WHEN turn = 0
         THEN '"**Issue Title:** ' || split_part(text, '.', 1) || chr(10) || '"**Issue Description:** ' || text
         ELSE '**Comment by ' || role || ':** ' || text END, chr(10) ORDER BY turn) AS issue_text,
       count(*) AS n_docs
FROM conversations GROUP BY conv_id""")
def q_issue_thread(t: Tables) -> DataFrame:
    """#55: first document is the issue, the rest comments by author."""
    c = t.conversations.withColumn("title", F.split_part("text", F.lit("."), F.lit(1)))
    return A.issue_text(c, "conv_id", "turn", "title", "text", "role")


# ------------------------------------------------------- logs, problems

PROBLEM_STATUS = "CASE CAST(get_json_object(props, '$.k') AS INT) % 6 WHEN 0 THEN 401 WHEN 1 THEN 403 " \
                 "WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 400 ELSE 500 END"
PROBLEM_STATUS_SQL = PROBLEM_STATUS.replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')")


def _problem_sql(st: str, rid: str, msg: str, rtype: str) -> str:
    def pick(i):
        whens = " ".join(f"WHEN {c} THEN {sql_str(v[i])}" for c, v in A.PROBLEMS.items())
        return f"(CASE {st} {whens} ELSE {sql_str(A.OTHER_PROBLEM[i])} END)"
    detail = (f"(CASE WHEN {st} = 404 THEN 'Google ' || coalesce({rtype}, 'resource') || ' ''' || coalesce({rid}, '') "
              f"|| ''' not found. API detail: ' || {msg} ELSE {msg} END)")
    return (f"{sql_str(A.PROBLEM_TYPE_PREFIX)} || {pick(1)} AS type, {pick(0)} AS title, CAST({st} AS INTEGER) AS status, "
            f"{detail} AS detail, {sql_str(A.PROBLEM_INSTANCE_PREFIX)} || {pick(2)} || '-' || coalesce({rid}, 'general') AS instance")


@register("to_problem", sql=f"""
WITH e AS (SELECT event_id, 'ev' || CAST(event_id AS VARCHAR) AS rid, {PROBLEM_STATUS_SQL} AS st,
                  'upstream said ' || event_type AS msg FROM events)
SELECT event_id, {_problem_sql('st', 'rid', 'msg', "'event'")} FROM e""")
def q_to_problem(t: Tables) -> DataFrame:
    """#96: status code -> RFC 7807 problem record."""
    e = t.events.select("event_id", F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("rid"),
                        F.expr(PROBLEM_STATUS).alias("st"),
                        F.concat(F.lit("upstream said "), F.col("event_type")).alias("msg"))
    p = A.to_problem(F.col("st"), F.col("rid"), F.col("msg"), F.lit("event"))
    return e.select("event_id", p.alias("p")).select("event_id", "p.*")


def _fill_sql(template: str, values: dict[str, str]) -> str:
    bits = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(f"coalesce(CAST({values[b]} AS VARCHAR), '')" if i % 2 else sql_str(b)
                             for i, b in enumerate(bits)) + ")"


def _case_sql(on: str, table: dict, i: int, other: str, values: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {sql_str(k) if isinstance(k, str) else k} THEN "
                     + (str(v[i]) if isinstance(v[i], int) else _fill_sql(v[i], values)) for k, v in table.items())
    return f"(CASE {on} {whens} ELSE {other} END)"


_MAIL_V = {"m": "msg", "s": "st"}
M_TYPE = "CASE event_id % 3 WHEN 0 THEN 'Message' WHEN 1 THEN 'Label' END"
M_ID = "CASE WHEN event_id % 2 = 0 THEN 'm' || CAST(event_id AS STRING) END"


@register("mail_problem", sql=f"""
WITH e AS (SELECT event_id, {PROBLEM_STATUS_SQL} AS st, 'upstream said ' || event_type AS msg, {M_TYPE} AS rt,
                  {M_ID.replace('AS STRING', 'AS VARCHAR')} AS rid FROM events)
SELECT event_id, {sql_str(A.MAIL_TYPE_PREFIX)} || {_case_sql('st', A.MAIL_PROBLEMS, 1, sql_str(A.OTHER_MAIL_PROBLEM[1]), _MAIL_V)} AS type,
       {_case_sql('st', A.MAIL_PROBLEMS, 0, sql_str(A.OTHER_MAIL_PROBLEM[0]), _MAIL_V)} AS title, CAST(st AS INTEGER) AS status,
       CASE WHEN st = 404 AND rt IS NOT NULL THEN rt || CASE WHEN rid IS NULL THEN '' ELSE ' with ID ' || chr(39) || rid || chr(39) END || ' not found.'
            ELSE {_case_sql('st', A.MAIL_PROBLEMS, 2, _fill_sql(A.OTHER_MAIL_PROBLEM[2], _MAIL_V), _MAIL_V)} END AS detail,
       CASE WHEN st = 401 THEN true END AS requires_reauth FROM e""")
def q_mail_problem(t: Tables) -> DataFrame:
    """#96: failed mail requests -> problem records."""
    e = t.events.select("event_id", A.mail_problem(F.expr(PROBLEM_STATUS), F.concat(F.lit("upstream said "), F.col("event_type")),
                                                   F.expr(M_TYPE), F.expr(M_ID)).alias("p"))
    return e.select("event_id", "p.*")


_KINDS = [*A.TRANSCRIPT_PROBLEMS, "never-heard-of"]
T_KIND = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {sql_str(k)}" for i, k in enumerate(_KINDS)) + " END"
T_VIDEO = "substr(md5(CAST(event_id AS STRING)), 1, 11)"
T_URL = f"'https://www.youtube.com/watch?v=' || {T_VIDEO} || '&list=' || md5(event_type)"
_TR_V = {"v": "v", "u": "u", "u50": "substr(u, 1, 50)", "a": "'captions'", "e": "event_type", "x": "'KeyError'"}


@register("transcript_problem", sql=f"""
WITH e AS (SELECT event_id, event_type, {T_KIND} AS k0, {T_VIDEO.replace('AS STRING', 'AS VARCHAR')} AS v,
                  {T_URL.replace('AS STRING', 'AS VARCHAR')} AS u FROM events),
f AS (SELECT *, CASE k0 WHEN 'never-heard-of' THEN 'generic-fetch-error' ELSE k0 END AS k FROM e)
SELECT event_id, {sql_str(A.TRANSCRIPT_TYPE_PREFIX)} || k AS type, {_case_sql('k', A.TRANSCRIPT_PROBLEMS, 0, 'NULL', _TR_V)} AS title,
       CAST(CASE WHEN k = 'google-auth-permission-error' AND event_id % 16 >= 8 THEN 403
                 ELSE {_case_sql('k', A.TRANSCRIPT_PROBLEMS, 1, 'NULL', _TR_V)} END AS INTEGER) AS status,
       {_case_sql('k', A.TRANSCRIPT_PROBLEMS, 2, 'NULL', _TR_V)} AS detail,
       {sql_str(A.TRANSCRIPT_INSTANCE_PREFIX)} || {_case_sql('k', A.TRANSCRIPT_PROBLEMS, 3, 'NULL', _TR_V)} AS instance FROM f""")
def q_transcript_problem(t: Tables) -> DataFrame:
    """#96: failed caption fetches -> problem records."""
    p = A.transcript_problem(F.expr(T_KIND), F.expr(T_VIDEO), F.expr(T_URL), F.lit("captions"), F.col("event_type"),
                             F.lit("KeyError"), denied=F.col("event_id") % 16 >= 8)
    return t.events.select("event_id", p.alias("p")).select("event_id", "p.*")


@register("dedupe_problems", sql=f"""
WITH p AS (SELECT user_id, {PROBLEM_STATUS_SQL} AS status, event_id FROM events WHERE event_type = 'error')
SELECT user_id, status, min(event_id) AS event_id, count(*) AS n_seen FROM p GROUP BY user_id, status""")
def q_dedupe_problems(t: Tables) -> DataFrame:
    """#58: one problem per (source, type), the first one kept."""
    p = t.events.filter(F.col("event_type") == "error").select(
        "user_id", F.expr(PROBLEM_STATUS).alias("status"), "event_id")
    d = A.dedupe_problems(p, "user_id", "status", "event_id")
    n = p.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n_seen"))
    return d.join(n, ["user_id", "status"]).select("user_id", "status", "event_id", "n_seen")


FETCH_CONTENT = "CASE WHEN event_type = 'error' THEN '' ELSE props END"


@register("first_success", sql=f"""
WITH l AS (SELECT user_id, event_id, event_type AS handler, {FETCH_CONTENT} AS content FROM events)
SELECT user_id, count(*) AS attempts, arg_min(event_id, event_id) FILTER (WHERE length(content) > 0) IS NOT NULL AS ok,
       min(event_id) FILTER (WHERE length(content) > 0) AS won_attempt,
       arg_min(handler, event_id) FILTER (WHERE length(content) > 0) AS handler,
       arg_min(content, event_id) FILTER (WHERE length(content) > 0) AS content
FROM l GROUP BY user_id""")
def q_first_success(t: Tables) -> DataFrame:
    """#66: first handler attempt with non-empty content per source."""
    log = t.events.select("user_id", "event_id", F.col("event_type").alias("handler"),
                          F.expr(FETCH_CONTENT).alias("content"))
    return A.first_success(log, "user_id", "event_id", "content", "handler")


@register("preferred_track", sql="""
SELECT source, arg_min(doc_id, (lang <> 'en', doc_id)) AS doc_id, arg_min(lang, (lang <> 'en', doc_id)) AS lang
FROM documents GROUP BY source""")
def q_preferred_track(t: Tables) -> DataFrame:
    """#67: preferred language (en) else the first track, per source."""
    return A.preferred_track(t.documents.select("source", "doc_id", "lang"), "source", "lang", "doc_id")


QUOTA_LIMIT, QUOTA_WINDOW = 3, 3600


@register("sliding_quota", sql=f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us
         RANGE BETWEEN {QUOTA_WINDOW * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS in_window,
       count(*) OVER (PARTITION BY user_id ORDER BY us
         RANGE BETWEEN {QUOTA_WINDOW * 1_000_000 - 1} PRECEDING AND CURRENT ROW) > {QUOTA_LIMIT} AS over_quota
FROM e""")
def q_sliding_quota(t: Tables) -> DataFrame:
    """#68: requests in the trailing window per user and over-quota flag."""
    return A.sliding_quota(t.events, "user_id", "ts", QUOTA_LIMIT, QUOTA_WINDOW).select(
        "event_id", "in_window", "over_quota")


@register("failure_streaks", sql="""
WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
                  - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island
           FROM events)
SELECT user_id, count(*) AS n_failures, min(event_id) AS first_event_id, max(event_id) AS last_event_id
FROM e WHERE failed GROUP BY user_id, island HAVING count(*) >= 3""")
def q_failure_streaks(t: Tables) -> DataFrame:
    """#69: runs of >= 3 consecutive failures per source (gap-and-island)."""
    s = A.failure_streaks(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.select("user_id", "n_failures", F.col("_first.event_id").alias("first_event_id"),
                    F.col("_last.event_id").alias("last_event_id"))


@register("extract_result", sql=f"""
WITH {X.url_cases_sql()},
p AS (SELECT url, page_id, {html_to_text_sql('html')} AS content FROM pages),
j AS (SELECT c.url, p.page_id, p.content FROM url_cases c LEFT JOIN p USING (url))
SELECT url, CAST(count(page_id) AS BIGINT) AS n_docs,
       CASE WHEN count(page_id) = 0 THEN '404' END AS problem_status,
       md5(coalesce(string_agg(content, chr(30) ORDER BY page_id), '')) AS contents_md5
FROM j GROUP BY url""")
def q_extract_result(t: Tables) -> DataFrame:
    """#70: per URL its documents in order; none -> problem record (status '404' as text)."""
    from corpuskit.operators import threads as TH
    pages = t.pages.select("url", "page_id", html_to_text("html").alias("content"))
    r = TH.extract_result(X.url_cases(t).select("url"), pages)
    return r.select("url", "n_docs", F.col("problem.status").alias("problem_status"),
                    F.md5(F.array_join(F.transform("contents", lambda c: c["content"]), "\u001e")).alias("contents_md5"))


# ------------------------------------------------------- conversations

KIND = ("CASE WHEN role = 'user' THEN 'user' WHEN role = 'system' THEN 'reasoning' "
        "WHEN turn % 3 = 0 THEN 'tool_call' WHEN turn % 3 = 1 THEN 'tool_return' ELSE 'assistant' END")


@register("conversation_views", sql=f"""
WITH m AS (SELECT conv_id, turn, text, {KIND} AS kind, length(text) % 2 = 0 AS nohb FROM conversations),
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
SELECT conv_id, arg_max(text, turn) FILTER (WHERE kind = 'user') AS last_user,
       coalesce(arg_min(text, turn) FILTER (WHERE kind = 'assistant'), 'No message found') AS first_assistant,
       '<think>' || coalesce(string_agg(chunk, '' ORDER BY turn) FILTER (WHERE kind <> 'user'), '') AS stream
FROM c GROUP BY conv_id""")
def q_conversation_views(t: Tables) -> DataFrame:
    """#97: last user message, first assistant reply, rendered reply stream."""
    m = t.conversations.select("conv_id", "turn", "text", F.expr(KIND).alias("kind"),
                               (F.length("text") % 2 == 0).alias("no_heartbeat"))
    return A.conversation_views(m)


# ------------------------------------------------------- pull requests

def pull_requests(t: Tables) -> DataFrame:
    stats = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("commits"), F.sum(F.col("l_quantity").cast("long")).alias("additions"),
        F.countDistinct("l_partkey").alias("changed_files"))
    o = (t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
         .join(stats, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("number"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "O", F.lit("open")).otherwise(F.lit("closed")).alias("state"),
        F.col("c_name").alias("author"), day.alias("created_at"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(day).alias("updated_at"),
        F.lit("main").alias("base_ref"), F.concat(F.lit("feature/"), F.col("o_orderkey").cast("string")).alias("head_ref"),
        (F.col("o_orderstatus") == "F").alias("merged"), day.alias("merged_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Priority "), F.col("o_orderpriority")))
         .alias("body"),
        "commits", "additions", F.lit(None).cast("long").alias("deletions"), "changed_files")


@register("pr_markdown", sql="""
WITH s AS (SELECT l_orderkey, count(*) AS commits, sum(CAST(l_quantity AS BIGINT)) AS additions,
                  count(DISTINCT l_partkey) AS changed_files FROM lineitem GROUP BY l_orderkey),
p AS (SELECT o_orderkey AS number, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
             CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, c.c_name AS author,
             strftime(o_orderdate, '%Y-%m-%d') AS created_at,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at,
             'feature/' || CAST(o_orderkey AS VARCHAR) AS head_ref, o_orderstatus = 'F' AS merged,
             CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Priority ' || o_orderpriority END AS body,
             s.commits, s.additions, s.changed_files
      FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN s ON s.l_orderkey = o_orderkey),
m AS (SELECT number, concat_ws(chr(10) || chr(10), '# ' || title, '**PR Number:** #' || CAST(number AS VARCHAR),
        '**State:** ' || state, '**Author:** ' || coalesce(author, 'N/A'), '**Created:** ' || created_at,
        '**Updated:** ' || coalesce(updated_at, 'N/A'), '**Branches:** ' || head_ref || ' → main',
        CASE WHEN merged THEN '**Merged:** ' || created_at END,
        CASE WHEN coalesce(body, '') <> '' THEN chr(10) || '## Description' END,
        CASE WHEN coalesce(body, '') <> '' THEN body END,
        chr(10) || '## Statistics', '**Commits:** ' || coalesce(CAST(commits AS VARCHAR), 'N/A'),
        '**Additions:** ' || coalesce(CAST(additions AS VARCHAR), 'N/A'), '**Deletions:** N/A',
        '**Changed Files:** ' || coalesce(CAST(changed_files AS VARCHAR), 'N/A')) AS markdown FROM p)
SELECT number, CAST(length(markdown) AS BIGINT) AS n_chars, md5(markdown) AS markdown_md5 FROM m""")
def q_pr_markdown(t: Tables) -> DataFrame:
    """#94: pull-request facts rendered with N/A defaults and optional sections."""
    from corpuskit.operators import threads as TH
    md = TH.pr_markdown(pull_requests(t))
    return md.select("number", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("markdown_md5"))
