"""#1 read_corpus / #73 union_converted: files of mixed type -> documents.

The scan is Spark's ``binaryFile`` source (path, modificationTime, length,
content). The converter is chosen per row from the MIME type (#2) and all
converters run as one CASE projection over a single scan - a bag union of
converter outputs without re-reading the files per converter. PDF rows are
kept with null text (no PDF parser is available; see README).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.mime import converter_of, mime_of
from corpuskit.functions.text import clean_document, html_to_text

# --- fixed values: markdown -> text rules (applied in this order) ----------
MD_RULES = [
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),      # images -> alt text
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),       # links -> link text
    (r"(?m)^#{1,6}[ \t]*", ""),             # heading marks
    (r"\*{1,3}", ""),                       # emphasis marks
    (r"`", ""),                             # inline code marks
]
# -----------------------------------------------------------------------------


def markdown_to_text(c: Column) -> Column:
    for pat, rep in MD_RULES:
        c = F.regexp_replace(c, pat, rep)
    return c


def decode_utf8(content: Column) -> Column:
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s)


def convert_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, mime, converter, text`` (cleaned; null for PDF / undecodable)."""
    mime = mime_of(F.col(path))
    conv = converter_of(mime)
    raw = decode_utf8(F.col(content))
    text = (F.when(conv == "html", html_to_text(raw))
             .when(conv == "markdown", markdown_to_text(raw))
             .when(conv == "pdf", F.lit(None).cast("string"))
             .otherwise(raw))
    out = files.select(F.col(path).alias("path"), mime.alias("mime"), conv.alias("converter"), text.alias("_t"))
    return out.withColumn("text", F.when(F.col("_t").isNotNull(), clean_document(F.col("_t")))).drop("_t")


def read_corpus(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Scan a folder tree with ``binaryFile`` and convert every file."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return convert_files(r.load(root))


def union_converted(*dfs: DataFrame) -> DataFrame:
    """#73: bag union of converted corpora (columns matched by name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
