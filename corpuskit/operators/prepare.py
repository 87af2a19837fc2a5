"""Document preparation: reject blanks, pre-split, chunk, number, key.

Everything here is row-local (no shuffle): a document row carries all its
sections, and each section row carries all its chunks, so chunk numbering
across the sections of a file is computed inside the row instead of with a
window over the whole corpus. A giant document becomes many section rows
before the chunk explode, which is also what keeps a single huge text from
turning into one huge task downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import collapse_whitespace, is_blank

# --- fixed values (ingest defaults) -----------------------------------------
CHUNK_WORDS = 400          # words per chunk
CHUNK_OVERLAP = 40         # words shared with the next chunk
PRESPLIT_OVER = 500_000    # texts longer than this (strictly) are pre-split
PRESPLIT_SECTION = 100_000  # section size in characters
CONTEXT_CHARS = 500        # chunk text kept for answer context
# -----------------------------------------------------------------------------


def drop_empty(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """#9: split into (kept, rejected); rejects carry an error message."""
    blank = is_blank(text_col)
    kept = df.filter(~blank)
    rejected = df.filter(blank).withColumn("error", F.lit("Empty text provided"))
    return kept, rejected


def n_chunks(n_words: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of sliding windows: 1 if n <= size else ceil((n-size)/step)+1."""
    step = size - overlap
    return F.when(n_words <= size, F.lit(1)).otherwise(
        F.ceil((n_words - size) / F.lit(float(step))).cast("int") + 1)


def pre_split(df: DataFrame, text_col: str = "text", over: int = PRESPLIT_OVER,
              section: int = PRESPLIT_SECTION) -> DataFrame:
    """#25: texts longer than ``over`` chars become ``section``-char pieces.

    Adds ``section_index`` / ``section_total`` (null when not split) and
    replaces ``text_col`` by the section text.
    """
    n = F.length(text_col)
    split = n > over
    total = F.ceil(n / F.lit(float(section))).cast("int")
    pieces = F.when(split, F.transform(
        F.sequence(F.lit(0), total - 1),
        lambda i: F.substring(F.col(text_col), i * section + 1, F.lit(section)))
    ).otherwise(F.array(F.col(text_col)))
    out = df.withColumn("_split", split).withColumn("_pieces", pieces).select(
        "*", F.posexplode_outer("_pieces").alias("_pos", "_section"))
    return (out.withColumn(text_col, F.col("_section"))
               .withColumn("section_index", F.when(F.col("_split"), F.col("_pos")))
               .withColumn("section_total", F.when(F.col("_split"), F.size("_pieces")))
               .drop("_split", "_pos", "_section", "_pieces"))


def chunk_document(df: DataFrame, file_col: str, text_col: str = "text",
                   size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
                   over: int = PRESPLIT_OVER, section: int = PRESPLIT_SECTION) -> DataFrame:
    """#25-28: pre-split, word chunks, chunk_index/total_chunks, page_number.

    Input: one row per file (``file_col`` unique), ``text_col`` already
    cleaned. Output: one row per chunk with ``content``, ``chunk_index``
    (0-based across all sections of the file), ``total_chunks``,
    ``page_number``, ``section_index``, ``section_total``; other input
    columns are carried.
    """
    step = size - overlap
    text = F.col(text_col)
    n = F.length(text)
    is_split = n > over
    n_sec = F.ceil(n / F.lit(float(section))).cast("int")
    sections = F.when(is_split, F.transform(
        F.sequence(F.lit(0), n_sec - 1),
        lambda i: F.substring(text, i * section + 1, F.lit(section)))
    ).otherwise(F.array(text))
    counts = F.col("_counts")
    # chunks in earlier sections of the same file (prefix sums inside the row)
    offsets = F.transform(counts, lambda _c, i: F.aggregate(
        F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x))

    sec = (df.withColumn("_is_split", is_split)
             .withColumn("_sections", sections)
             # words = separators + 1 (same count as split(s, ' '), no array built)
             .withColumn("_counts", F.transform(
                 "_sections", lambda s: n_chunks(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1,
                                                 size, overlap)))
             .withColumn("_n_sec", F.size("_sections"))
             .withColumn("total_chunks", F.aggregate(counts, F.lit(0), lambda a, x: a + x))
             # *_outer: no inferred size() > 0 filter that would recompute the arrays
             .select("*", F.posexplode_outer(F.arrays_zip(F.col("_sections").alias("s"), offsets.alias("o")))
                     .alias("_spos", "_sec"))
             .drop("_sections", "_counts"))
    sec = (sec
             .withColumn("section_index", F.when(F.col("_is_split"), F.col("_spos")))
             .withColumn("section_total", F.when(F.col("_is_split"), F.col("_n_sec")))
             .withColumn("_words", F.split(F.col("_sec.s"), " "))
             .withColumn("_has_ff", F.instr(F.col("_sec.s"), "\f") > 0)
             .withColumn("_offset", F.col("_sec.o")))

    words = F.col("_words")
    nw = F.size(words)
    has_ff = F.col("_has_ff")
    ff_per_word = F.transform(words, lambda w: F.length(w) - F.length(F.replace(w, F.lit("\f"), F.lit(""))))

    def chunk(k):
        start = k * step
        body = F.array_join(F.slice(words, start + 1, F.lit(size)), " ")
        content = F.concat(body, F.when(start + size < nw, F.lit(" ")).otherwise(F.lit("")))
        # pages: form feeds in the non-overlapping heads of earlier chunks
        page = F.when(has_ff, F.aggregate(F.slice(ff_per_word, 1, start), F.lit(0),
                                          lambda a, x: a + x) + 1).otherwise(F.lit(1))
        return F.struct(k.alias("k"), content.alias("content"), page.alias("page_number"))

    chunks = F.transform(F.sequence(F.lit(0), n_chunks(nw, size, overlap) - 1), chunk)
    out = sec.select("*", F.explode_outer(chunks).alias("_chunk"))
    return (out.withColumn("chunk_index", F.col("_offset") + F.col("_chunk.k"))
               .withColumn("content", F.col("_chunk.content"))
               .withColumn("page_number", F.col("_chunk.page_number"))
               .drop("_is_split", "_n_sec", "_spos", "_sec", "_words", "_has_ff", "_offset", "_chunk", text_col))


def prepare_chunks(docs: DataFrame, ingested_at: str, size: int = CHUNK_WORDS,
                   overlap: int = CHUNK_OVERLAP, over: int = PRESPLIT_OVER,
                   section: int = PRESPLIT_SECTION) -> DataFrame:
    """Ingest path on the ``documents`` table: #9 -> #8 -> #25-28.

    ``source_filename`` = ``<source>/<doc_id>.txt`` (one file per document).
    Output follows the chunk store schema plus ``doc_id``.
    """
    kept, _ = drop_empty(docs)
    files = kept.select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("_f"),
        collapse_whitespace("text").alias("text"),
    ).withColumn("source_filename", F.concat("_f", F.lit(".txt"))).drop("_f")
    chunks = chunk_document(files, "source_filename", "text", size, overlap, over, section)
    return chunks.select(
        "doc_id", "source_filename", "chunk_index", "total_chunks", "page_number",
        "section_index", "section_total", "content",
        F.lit("").alias("source_room_id"), F.lit("").alias("source_sender"),
        F.lit(None).cast("string").alias("section_title"),
        F.lit(ingested_at).alias("ingested_at"))


def truncate_chunks(c, n: int = CONTEXT_CHARS) -> Column:
    """#32: first ``n`` characters (code points) of a chunk."""
    return F.substring(F.col(c) if isinstance(c, str) else c, 1, n)


def content_key(chunk_id: Column, doc_id: Column, filename: Column, chunk_index: Column) -> Column:
    """#34: meta.chunk_id -> non-empty doc id -> 'filename:chunk_index'."""
    fallback = F.concat_ws(":", F.coalesce(filename, F.lit("unknown")),
                           F.coalesce(chunk_index.cast("string"), F.lit("None")))
    return F.coalesce(chunk_id, F.nullif(doc_id, F.lit("")), fallback)


def chunk_sha(filename: Column, chunk_index: Column, content: Column) -> Column:
    """Stable content-addressed id for a stored chunk."""
    return F.sha2(F.concat_ws("\u0001", filename, chunk_index.cast("string"), content), 256)
