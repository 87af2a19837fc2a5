"""Result shapes: evidence rows, source pointers, citations, context blocks,
response envelopes and JSON (#7, #44-48).

Null rules kept from the reference: ``page_number or page`` is a falsy-or
chain (0 and '' count as missing), ``page`` is emitted when non-null,
``section`` only when non-empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.prepare import CONTEXT_CHARS

# --- fixed values ------------------------------------------------------------
NO_DOCS_MESSAGE = "No documents found matching your query."
# -----------------------------------------------------------------------------


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _falsy_or(a: Column, b: Column, dtype: str) -> Column:
    """Python ``a or b`` for ints/strings: 0 / '' / null fall through."""
    if dtype == "string":
        return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), b)
    return F.coalesce(F.nullif(a, F.lit(0)), b)


def page_of(df: DataFrame) -> Column:
    return _falsy_or(_opt(df, "page_number", "int").cast("long"), _opt(df, "page", "int").cast("long"), "int")


def section_of(df: DataFrame) -> Column:
    return _falsy_or(_opt(df, "section_title"), _opt(df, "section"), "string")


def raw_results(df: DataFrame) -> DataFrame:
    """#44: the 11-field evidence row (other columns are kept in front)."""
    fname = F.coalesce(_opt(df, "source_filename"), F.lit("unknown"))
    chunk_id = F.coalesce(
        _opt(df, "chunk_id"), F.nullif(_opt(df, "id"), F.lit("")),
        F.concat_ws(":", fname, F.coalesce(_opt(df, "chunk_index", "int").cast("string"), F.lit("None"))))
    extra = [c for c in df.columns if c in ("query_id", "rank")]
    return df.select(
        *extra,
        chunk_id.alias("chunk_id"), F.col("content"), F.col("score"),
        fname.alias("filename"),
        _opt(df, "chunk_index", "int").cast("long").alias("chunk_index"),
        _opt(df, "total_chunks", "int").cast("long").alias("total_chunks"),
        page_of(df).alias("page"), section_of(df).alias("section"),
        F.coalesce(_opt(df, "source_room_id"), F.lit("")).alias("room_id"),
        F.coalesce(_opt(df, "source_sender"), F.lit("")).alias("sender"),
        F.coalesce(_opt(df, "ingested_at"), F.lit("")).alias("ingested_at"))


def source_pointers(df: DataFrame) -> DataFrame:
    """#45: filename, chunk, of, score(3 dp), page if non-null, section if non-empty."""
    sec = section_of(df)
    extra = [c for c in df.columns if c in ("query_id", "rank")]
    return df.select(
        *extra,
        F.coalesce(_opt(df, "source_filename"), F.lit("unknown")).alias("filename"),
        _opt(df, "chunk_index", "int").cast("long").alias("chunk"),
        _opt(df, "total_chunks", "int").cast("long").alias("of"),
        F.round("score", 3).alias("score"),
        page_of(df).alias("page"),
        F.when(sec.isNotNull() & (sec != ""), sec).alias("section"))


def citation_line(filename: Column, page: Column, section: Column, chunk: Column,
                  total: Column, score: Column) -> Column:
    """#46: ``- file page P § S chunk i/n (score: s)``; missing parts omitted."""
    return F.concat(
        F.lit("- "), filename,
        F.when(page.isNotNull(), F.concat(F.lit(" page "), page.cast("string"))).otherwise(F.lit("")),
        F.when(section.isNotNull() & (section != ""), F.concat(F.lit(" § "), section)).otherwise(F.lit("")),
        F.lit(" chunk "), F.coalesce(chunk.cast("string"), F.lit("None")), F.lit("/"),
        F.coalesce(total.cast("string"), F.lit("None")),
        F.lit(" (score: "), F.format_number(score, 3), F.lit(")"))


def context_block(df: DataFrame, qid: str, rank: str, block: Column, sep: str = "\n\n") -> DataFrame:
    """#47: one text per query, blocks in rank order (``listagg`` within group)."""
    sep_sql = sep.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'")
    return (df.withColumn("_block", block).groupBy(qid)
              .agg(F.expr(f"listagg(_block, '{sep_sql}') WITHIN GROUP (ORDER BY {rank})").alias("context"),
                   F.count(F.lit(1)).alias("n_blocks")))


def chunk_block(content: Column, filename: Column, chunk: Column, n: int = CONTEXT_CHARS) -> Column:
    """Tagged context block of a chunk (content cut to ``n`` chars)."""
    return F.concat(F.lit("<document source=\""), filename, F.lit("\" chunk=\""),
                    chunk.cast("string"), F.lit("\">\n"), F.substring(content, 1, n),
                    F.lit("\n</document>"))


def _shown(c: Column, null: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(null))


def page_block(title: Column, url: Column, content: Column, score: Column | None = None) -> Column:
    """Context block of a web hit (with its ``score``; None when it has none) or of an extracted page."""
    sc = [] if score is None else [F.lit("<score>"), _shown(score, "None"), F.lit("</score>\n")]
    return F.concat(F.lit("<document>\n<title>"), _shown(title), F.lit("</title>\n"), *sc, F.lit("<url>"), _shown(url),
                    F.lit("</url>\n<content> \n"), _shown(content), F.lit("\n</content>\n</document>"))


def mail_block(subject: Column, sender: Column, date: Column, snippet: Column, content: Column) -> Column:
    """Context block of a mail message."""
    lines = [("Subject", subject), ("From", sender), ("Date", date), ("Snippet", snippet), ("Content", content)]
    return F.concat(F.lit("  --- Email Start ---\n"),
                    *[x for name, c in lines for x in (F.lit(f"  {name}: "), _shown(c), F.lit("\n"))],
                    F.lit("  --- Email End ---"))


def response_envelope(queries: DataFrame, hits: DataFrame, qid: str) -> DataFrame:
    """#48: per query status/mode/counts/answer.

    ``queries``: qid, resolved_mode, error, answer (input text; null = the
    answer step failed). ``hits``: qid plus result rows after threshold.
    """
    counts = hits.groupBy(qid).agg(F.count(F.lit(1)).alias("total_results"))
    q = queries.join(counts, qid, "left").withColumn("total_results", F.coalesce("total_results", F.lit(0)))
    mode = F.col("resolved_mode")
    none = F.col("total_results") == 0
    failed = F.col("answer").isNull() & ~none & mode.isin("synthesis", "both")
    status = F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("ok"))
    out_mode = (F.when(F.col("error").isNotNull(), F.lit(None))
                 .when(none, F.when(mode == "synthesis", F.lit("smart")).otherwise(mode))
                 .when(mode == "raw", F.lit("raw"))
                 .when(failed, F.lit("raw"))
                 .otherwise(F.lit("smart")))
    out_rmode = (F.when(F.col("error").isNotNull(), F.lit(None))
                  .when(failed, F.lit("raw")).otherwise(mode))
    answer = (F.when(F.col("error").isNotNull(), F.lit(None))
               .when(none, F.when(mode.isin("synthesis", "both"), F.lit(NO_DOCS_MESSAGE)))
               .when(mode == "raw", F.lit(None))
               .when(failed, F.lit(None))
               .otherwise(F.col("answer")))
    has_evidence = F.col("error").isNull() & (none | (mode != "synthesis") | failed)
    has_sources = F.col("error").isNull() & ~none & mode.isin("synthesis", "both") & ~failed
    detail = (F.when(F.col("error").isNotNull(), F.col("error"))
               .when(failed, F.lit("LLM unavailable, returning raw chunks")))
    return q.select(qid, status.alias("status"), out_mode.alias("mode"),
                    out_rmode.alias("response_mode"), answer.alias("answer"),
                    F.when(F.col("error").isNull(), F.col("total_results")).alias("total_results"),
                    has_evidence.alias("has_evidence"), has_sources.alias("has_sources"),
                    detail.alias("detail"))


def result_json(df: DataFrame, cols: list[str], ignore_nulls: bool = False) -> Column:
    """#7: JSON envelope of the given columns, non-ASCII kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": str(ignore_nulls).lower()})
