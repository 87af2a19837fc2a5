"""Text column functions (all JVM-side built-ins, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# English stop words for keyword scoring: the classic 33-word English analyzer
# list (public), kept verbatim and in its natural order.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
# Token boundary: anything that is not a letter or a digit (Unicode aware, and
# the same class means the same thing in Java regex and RE2).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Whitespace as Python's str.strip()/split() sees it for ASCII input.
BLANK_RE = r"^[ \t\n\r\f\x0B]*$"
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(c) -> Column:
    """#8: three or more newlines -> two, then runs of spaces/tabs -> one space."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")


def is_blank(c) -> Column:
    """Null, empty or whitespace-only."""
    return _c(c).isNull() | _c(c).rlike(BLANK_RE)


def clean_document(c) -> Column:
    """#29: per page (form-feed separated): drop blank lines, squeeze runs of
    two or more whitespace characters to one space, strip; pages rejoined."""
    def page(p):
        lines = F.filter(F.split(p, "\n"), lambda ln: ~ln.rlike(r"^\s*$"))
        squeezed = F.regexp_replace(F.array_join(lines, "\n"), r"\s\s+", " ")
        return F.regexp_replace(squeezed, r"^\s+|\s+$", "")
    return F.array_join(F.transform(F.split(_c(c), "\f"), page), "\f")


def tokens(c, stop_words: list[str] | None = None, distinct: bool = False) -> Column:
    """#35: lower-cased letter/digit tokens minus stop words (array<string>), ``distinct``: each once."""
    stop = STOP_WORDS if stop_words is None else stop_words
    toks = F.split(F.lower(_c(c)), TOKEN_SPLIT)
    toks = F.array_distinct(toks) if distinct else toks
    return F.filter(toks, lambda t: (t != "") & ~t.isin(stop))


def error_line(c) -> Column:
    """#95: the first line of a stack trace is the search text."""
    return F.split_part(_c(c), F.lit("\n"), F.lit(1))


# HTML -> text (#30) as a chain of regex rewrites: drop script/style/nav/footer
# blocks and comments, turn block tags into newlines, drop the remaining tags,
# decode the common entities, tidy whitespace.
DROP_TAGS = ["script", "style", "nav", "footer", "head", "noscript"]
_COMMENTS = r"(?s)<!--.*?-->"
_BLOCK_TAGS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|main|blockquote|pre)\b[^>]*>"
_TAGS = r"(?s)<[^>]*>"
# fixed values: entity -> character, applied in this order (&amp; last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_to_text(c) -> Column:
    x = _c(c)
    x = F.regexp_replace(x, _COMMENTS, "")
    for tag in DROP_TAGS:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    x = F.regexp_replace(x, _BLOCK_TAGS, "\n")
    x = F.regexp_replace(x, _TAGS, "")
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def html_title(c, mime: Column | None = None) -> Column:
    """#31: first <title> of an HTML page, '' otherwise."""
    title = F.regexp_extract(_c(c), r"(?is)<title[^>]*>(.*?)</title>", 1)
    if mime is None:
        return title
    return F.when(mime == F.lit("text/html"), title).otherwise(F.lit(""))
