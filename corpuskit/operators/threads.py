"""Nested Q&A threads, their markdown, and per-URL extract results (#53, #70, #94).

Every collected list is bounded by one owner (a question's answers, a URL's
converted documents), never by the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.activity import ANONYMOUS, UNTITLED_QUESTION, numbered

# --- fixed values ------------------------------------------------------------
NOT_FOUND_TITLE = "Not Found"
VIEW_LABEL = "View on Stack Overflow"
# -----------------------------------------------------------------------------

LAST = 2**31 - 1      # place of a closing part
BLOCK = 1024          # places that one window numbers at a time

_ANSWER_FIELDS = ["answer_id", "seq", "score", "is_accepted", "body", "owner", "creation_date"]


def nest_thread(questions: DataFrame, answers: DataFrame, qid: str = "question_id") -> DataFrame:
    """#53: question row + ``answers`` array ordered by score desc (missing 0), stable."""
    sort_key = F.struct((-F.coalesce(F.col("score"), F.lit(0))).alias("_k"), F.col("seq").alias("_s"),
                        *[F.col(c) for c in _ANSWER_FIELDS])
    grouped = answers.groupBy(qid).agg(F.sort_array(F.collect_list(sort_key)).alias("_a"))
    strip = F.transform("_a", lambda a: F.struct(*[a[c].alias(c) for c in _ANSWER_FIELDS]))
    empty = F.array().cast(answers.select(F.array(F.struct(*_ANSWER_FIELDS)).alias("x")).schema["x"].dataType)
    return (questions.join(grouped, qid, "left")
            .withColumn("answers", F.coalesce(strip, empty))
            .withColumn("n_answers", F.size("answers").cast("long")).drop("_a"))


def thread_markdown(questions: DataFrame, answers: DataFrame, qid: str = "question_id") -> DataFrame:
    """#94 page view: title, score, asker, date, body, then numbered answers."""
    n = nest_thread(questions, answers, qid)
    nl2 = F.lit("\n\n")
    head = F.concat(
        F.lit("# "), F.coalesce("title", F.lit(UNTITLED_QUESTION)), nl2,
        F.lit("**Score**: "), F.coalesce(F.col("score"), F.lit(0)).cast("string"), F.lit(" | "),
        F.lit("**Asked by**: "), F.coalesce("owner", F.lit(ANONYMOUS)), F.lit(" | "),
        F.lit("**Date**: "), F.coalesce("creation_date", F.lit("")), nl2,
        F.coalesce("body", F.lit("")), F.lit("\n\n---\n\n"),
        F.lit("## "), F.col("n_answers").cast("string"), F.lit(" Answers\n\n"))
    blocks = F.transform("answers", lambda a, i: F.concat(
        F.lit("### Answer "), (i + 1).cast("string"), F.lit(" (Score: "),
        F.coalesce(a["score"], F.lit(0)).cast("string"), F.lit(")\n\n"),
        F.lit("**Answered by**: "), F.coalesce(a["owner"], F.lit(ANONYMOUS)), F.lit(" | "),
        F.lit("**Date**: "), F.coalesce(a["creation_date"], F.lit("")), nl2,
        F.coalesce(a["body"], F.lit("")), F.lit("\n\n---\n\n")))
    return n.select(qid, F.concat(head, F.array_join(blocks, "")).alias("markdown"))


def _text(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default))


def _parts(qid: str, *frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(qid, F.col("part").cast("long").alias("part"), F.col("sub").cast("long").alias("sub"), "text")


def _part(part, sub, text: Column) -> Column:
    """One part of a thread: (part, sub, text)."""
    place = [(x if isinstance(x, Column) else F.lit(x)).cast("long").alias(n) for n, x in (("part", part), ("sub", sub))]
    return F.struct(*place, text.alias("text"))


def _placed_answers(answers: DataFrame, qid: str) -> DataFrame:
    """Answers with their place (``part``, from 1) by score desc (missing 0), then in their order."""
    return numbered(answers, [qid], [-F.coalesce(F.col("score"), F.lit(0)), F.floor(F.col("seq") / BLOCK)],
                    ["seq", "answer_id", "body", "owner", "creation_date", "is_accepted", "score"], "part")


def thread_comments(comments: DataFrame, qid: str = "question_id") -> DataFrame:
    """#53: comments numbered (``pos``) under their answer, or under the question
    where ``answer_id`` is null, in their own order (``seq``)."""
    return numbered(comments, [qid, "answer_id"], [F.floor(F.col("seq") / BLOCK)], ["seq", "body", "score"])


def thread_search_parts(questions: DataFrame, answers: DataFrame, comments: DataFrame | None = None,
                        qid: str = "question_id") -> DataFrame:
    """#94 search layout, with accepted marks and (when given) comments:
    ``qid, part, sub, text``.

    A thread's markdown is its texts joined in (part, sub) order; they stay
    rows, so a question with very many answers is not one value in one task.
    Part 0 is the question, part n its n-th answer, the last part the link.
    """
    n = answers.groupBy(qid).agg(F.count(F.lit(1)).alias("_n"))
    q = questions.join(n, qid, "left")
    a = _placed_answers(answers, qid)
    head = F.concat(F.lit("# "), _text("title", UNTITLED_QUESTION), F.lit("\n\n**Score:** "), _text("score", "0"),
                    F.lit(" | **Answers:** "), _text("_n", "0"), F.lit("\n\n## Question\n\n"), _text("body"), F.lit("\n\n"))
    block = F.concat(F.lit("### "), F.when(F.col("is_accepted"), F.lit("✓ ")).otherwise(F.lit("")),
                     F.lit("Answer (Score: "), _text("score", "0"), F.lit(")\n\n"), _text("body"), F.lit("\n\n"))
    tail = F.concat(F.lit("---\n\n["), F.lit(VIEW_LABEL), F.lit("]("), _text("link"), F.lit(")\n\n"))
    end = _part(LAST, 0, tail)
    if comments is None:
        return q.select(qid, F.inline(F.array(_part(0, 0, head), _part(0, LAST, F.lit("## Answers\n\n")), end))).unionByName(
            a.select(qid, F.inline(F.array(_part(F.col("part"), 0, block)))))
    own = comments.filter(F.col("answer_id").isNull()).select(qid).distinct()
    q = q.join(own.withColumn("_has", F.lit(True)), qid, "left")
    title = F.when(F.col("_has"), F.lit("### Question Comments\n\n")).otherwise(F.lit(""))
    gap = F.when(F.col("_has"), F.lit("\n")).otherwise(F.lit(""))
    c = thread_comments(comments, qid).select(
        qid, "answer_id", F.col("pos").alias("sub"),
        F.concat(F.lit("- "), _text("body"), F.lit(" *(Score: "), _text("score", "0"), F.lit(")*\n")).alias("text"))
    # questions and answers are read and numbered once for all their parts: an
    # answer's own parts go with its first comment, or alone where it has none
    answered = a.select(qid, "answer_id", "part", block.alias("_block")).join(
        c.filter(F.col("answer_id").isNotNull()), [qid, "answer_id"], "left")
    begin = _part(F.col("part"), 0, F.concat("_block", F.lit("#### Answer Comments\n\n")))
    close, comment = _part(F.col("part"), LAST, F.lit("\n")), _part(F.col("part"), F.col("sub"), F.col("text"))
    each = (F.when(F.col("sub").isNull(), F.array(begin, close)).when(F.col("sub") == 1, F.array(begin, close, comment))
             .otherwise(F.array(comment)))
    return (q.select(qid, F.inline(F.array(_part(0, 0, F.concat(head, title)),
                                           _part(0, LAST, F.concat(gap, F.lit("## Answers\n\n"))), end)))
             .unionByName(c.filter(F.col("answer_id").isNull()).select(qid, F.inline(F.array(_part(0, F.col("sub"), F.col("text"))))))
             .unionByName(answered.select(qid, F.inline(each))))


def thread_context_parts(questions: DataFrame, answers: DataFrame, qid: str = "question_id") -> DataFrame:
    """#47 question-and-answer context: ``qid, part, sub, text``, joined in
    (part, sub) order (rows, as in ``thread_search_parts``)."""
    n = answers.groupBy(qid).agg(F.count(F.lit(1)).alias("_n"))
    q = questions.join(n, qid, "left")

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>\n"))

    tags = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    head = F.concat(F.lit("<question>\n"), tag("title", _text("title")), tag("score", _text("score")),
                    tag("answer_count", _text("_n", "0")), tag("creation_date", _text("creation_date")),
                    tag("tags", F.coalesce(tags, F.lit(""))), tag("url", _text("link")), tag("question_id", _text(qid)),
                    F.lit("<question_body> \n"), _text("body"), F.lit("\n</question_body>\n<answers>\n"))
    yes = F.when(F.col("is_accepted"), F.lit("True")).otherwise(F.lit("False"))
    block = F.concat(F.lit("\n<answer>\n"), tag("is_accepted", yes), tag("score", _text("score")),
                     tag("creation_date", _text("creation_date")), tag("answer_id", _text("answer_id")),
                     F.lit("<answer_body>\n"), _text("body"), F.lit("\n</answer_body>\n</answer>\n"))
    zero = F.lit(0).alias("sub")
    return _parts(qid, q.select(qid, F.lit(0).alias("part"), zero, head.alias("text")),
                  _placed_answers(answers, qid).select(qid, "part", zero, block.alias("text")),
                  q.select(qid, F.lit(LAST).alias("part"), zero, F.lit("\n</answers>\n</question>").alias("text")))


def extract_result(urls: DataFrame, docs: DataFrame, url: str = "url", seq: str = "page_id",
                   content: str = "content") -> DataFrame:
    """#70: per URL the ordered contents of its documents; none -> a problem
    record whose status is the text '404'."""
    j = urls.select(url).distinct().join(docs, url, "left")  # a URL listed twice is extracted once
    g = j.groupBy(url).agg(
        F.sort_array(F.collect_list(F.when(F.col(seq).isNotNull(), F.struct(F.col(seq).alias("seq"),
                                                                              F.col(content).alias("content")))))
         .alias("contents"))
    problem = F.struct(F.lit("about:blank").alias("type"), F.lit(NOT_FOUND_TITLE).alias("title"),
                       F.lit("404").alias("status"),
                       F.concat(F.lit("No content extracted from "), F.col(url)).alias("detail"),
                       F.col(url).alias("instance"))
    return (g.withColumn("n_docs", F.size("contents").cast("long"))
             .withColumn("problem", F.when(F.col("n_docs") == 0, problem)))


def pr_markdown(prs: DataFrame) -> DataFrame:
    """#94 pull-request facts -> markdown; ``N/A`` for missing facts, the
    merged line only when merged, description only when non-empty.

    Columns: number, title, state, author, created_at, updated_at, base_ref,
    head_ref, merged, merged_at, body, commits, additions, deletions,
    changed_files.
    """
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    parts = [
        F.concat(F.lit("# "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("**PR Number:** #"), na("number")),
        F.concat(F.lit("**State:** "), na("state")),
        F.concat(F.lit("**Author:** "), na("author")),
        F.concat(F.lit("**Created:** "), na("created_at")),
        F.concat(F.lit("**Updated:** "), na("updated_at")),
        F.concat(F.lit("**Branches:** "), na("head_ref"), F.lit(" → "), na("base_ref")),
        F.when(F.coalesce(F.col("merged"), F.lit(False)), F.concat(F.lit("**Merged:** "), na("merged_at"))),
        F.when(F.coalesce(F.col("body"), F.lit("")) != "", F.lit("\n## Description")),
        F.when(F.coalesce(F.col("body"), F.lit("")) != "", F.col("body")),
        F.lit("\n## Statistics"),
        F.concat(F.lit("**Commits:** "), na("commits")),
        F.concat(F.lit("**Additions:** "), na("additions")),
        F.concat(F.lit("**Deletions:** "), na("deletions")),
        F.concat(F.lit("**Changed Files:** "), na("changed_files")),
    ]
    return prs.select("number", F.concat_ws("\n\n", *parts).alias("markdown"))
