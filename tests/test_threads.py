"""Thread parts against a plain rendering, numbering in blocks, problem records."""

from pyspark.sql import functions as F

from corpuskit.operators import activity as A
from corpuskit.operators import threads as TH

QUESTIONS = [(1, "T1", 4, "why", "2024-01-01", ["a", "b"], "https://q/1"), (2, None, None, None, None, None, None)]
ANSWERS = [(11, 1, 1, 2, False, "low", "x", "2024-01-02"), (12, 1, 2, 9, True, "high", "y", "2024-01-03"),
           (13, 1, 3, None, False, "none", "z", "2024-01-04")]
COMMENTS = [(1, None, 1, 3, "on the question"), (1, 12, 1, None, "first"), (1, 12, 2, 5, "second")]


def frames(spark):
    q = spark.createDataFrame(QUESTIONS, "question_id long, title string, score int, body string, creation_date string, "
                                         "tags array<string>, link string")
    a = spark.createDataFrame(ANSWERS, "answer_id long, question_id long, seq int, score int, is_accepted boolean, "
                                       "body string, owner string, creation_date string")
    c = spark.createDataFrame(COMMENTS, "question_id long, answer_id long, seq int, score int, body string")
    return q, a, c


def joined(parts):
    rows = sorted((r.question_id, r.part, r["sub"], r.text) for r in parts.collect())
    return {k: "".join(r[3] for r in rows if r[0] == k) for k in {r[0] for r in rows}}


def test_search_layout(spark):
    q, a, c = frames(spark)
    got = joined(TH.thread_search_parts(q, a, c))
    assert got[1] == (
        "# T1\n\n**Score:** 4 | **Answers:** 3\n\n## Question\n\nwhy\n\n### Question Comments\n\n"
        "- on the question *(Score: 3)*\n\n## Answers\n\n"
        "### ✓ Answer (Score: 9)\n\nhigh\n\n#### Answer Comments\n\n- first *(Score: 0)*\n- second *(Score: 5)*\n\n"
        "### Answer (Score: 2)\n\nlow\n\n#### Answer Comments\n\n\n### Answer (Score: 0)\n\nnone\n\n#### Answer Comments\n\n\n"
        "---\n\n[View on Stack Overflow](https://q/1)\n\n")
    assert got[2] == ("# Untitled Question\n\n**Score:** 0 | **Answers:** 0\n\n## Question\n\n\n\n## Answers\n\n"
                      "---\n\n[View on Stack Overflow]()\n\n")
    plain = joined(TH.thread_search_parts(q, a))[1]
    assert "Comments" not in plain and plain.count("### ") == 3


def test_context_parts(spark):
    q, a, _ = frames(spark)
    got = joined(TH.thread_context_parts(q, a))[1]
    assert got.startswith("<question>\n<title>T1</title>\n<score>4</score>\n<answer_count>3</answer_count>\n")
    assert "<tags>['a', 'b']</tags>" in got and got.count("<answer>") == 3 and got.endswith("\n</answers>\n</question>")
    assert got.index("high") < got.index("low") < got.index("none")


def test_numbered_crosses_blocks(spark):
    rows = [(g, i) for g in ("hot", "cold", None) for i in range(50 if g == "hot" else 3)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(7)
    got = A.numbered(df, ["g"], [F.floor(F.col("i") / 8)], ["i"]).collect()
    assert sorted((str(r.g), r.i, r.pos) for r in got) == sorted((str(g), i, i + 1) for g, i in rows)


def test_mail_and_caption_problems(spark):
    df = spark.createDataFrame([(404, "Message", "m1"), (404, "Label", None), (404, None, None), (401, None, None), (502, None, None),
                                (None, None, None)], "st int, t string, i string")
    got = [r.p for r in df.select(A.mail_problem(F.col("st"), F.lit("oops"), F.col("t"), F.col("i")).alias("p")).collect()]
    assert [p.detail for p in got[:3]] == ["Message with ID 'm1' not found.", "Label not found.",
                                           "Google API resource not found: oops"]
    assert got[3].requires_reauth and got[3].title == "Authentication Error"
    assert (got[4].status, got[4].detail) == (502, "Google API request failed with status 502: oops")
    assert (got[5].status, got[5].title) == (500, "Google API Error")
    df = spark.createDataFrame([("video-unavailable",), ("strange",), (None,)], "k string")
    p = A.transcript_problem(F.col("k"), F.lit("v1"), F.lit("u"), F.lit("api"), F.lit("e"), F.lit("KeyError")).alias("p")
    got = [r.p for r in df.select(p).collect()]
    assert got[0].detail == "Video v1 (u) is unavailable. API: api. Original error: e" and got[0].status == 404
    assert got[1].type.endswith("generic-fetch-error") and got[2].status == 500
    assert got[1].detail == "Failed to fetch transcript for video v1 (u) using api. Original error: KeyError - e"


def test_answers_and_comments_are_numbered_once_for_all_parts(spark):
    """The plan of the search layout numbers answers once, and comments once under answers and once under questions."""
    q = spark.createDataFrame([(1, "t", 1, "b", "l")], "question_id long, title string, score int, body string, link string")
    a = spark.createDataFrame([(11, 1, 1, 5, True, "x", "o", "2020"), (12, 1, 2, None, False, "y", "o", "2020")],
                              "answer_id long, question_id long, seq int, score int, is_accepted boolean, body string, owner string, creation_date string")
    c = spark.createDataFrame([(1, None, 1, 1, "qc"), (1, 11, 2, 2, "c1"), (1, 11, 3, 3, "c2")],
                              "question_id long, answer_id long, seq int, score int, body string")
    out = TH.thread_search_parts(q, a, c)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 3
    assert [(r["part"], r["sub"]) for r in out.orderBy("part", "sub").collect()] == [
        (0, 0), (0, 1), (0, TH.LAST), (1, 0), (1, 1), (1, 2), (1, TH.LAST), (2, 0), (2, TH.LAST), (TH.LAST, 0)]


def test_large_groups_are_numbered_in_blocks_like_small_ones(spark):
    """Groups above ``whole`` rows are split, the others are one window; both give the same numbers, null groups too."""
    from pyspark.sql import functions as F

    from corpuskit.operators import activity as A
    rows = [(g, None if i % 9 == 4 else i % 5, i) for g, n in ((1, 60), (2, 7), (None, 30), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, score int, seq int")
    blocks = [-F.coalesce(F.col("score"), F.lit(0)), F.floor(F.col("seq") / 8)]
    got = [sorted(map(str, A.numbered(df, ["g"], blocks, ["seq"], whole=w).collect())) for w in (0, 20, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    def names(w):
        return A.numbered(df, ["g"], blocks, ["seq"], whole=w)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in names(1000) and "Join" in names(20)
