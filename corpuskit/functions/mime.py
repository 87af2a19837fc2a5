"""MIME classification of file names and URLs (#2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# Extension -> MIME type for the types the converters care about (standard
# registrations, plus ``.mdx`` which is added explicitly).
EXT_MIME = {
    "txt": "text/plain", "text": "text/plain", "html": "text/html", "htm": "text/html",
    "csv": "text/csv", "md": "text/markdown", "markdown": "text/markdown", "mdx": "text/mdx",
    "pdf": "application/pdf", "json": "application/json", "xml": "text/xml",
    "py": "text/x-python", "js": "text/javascript", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "zip": "application/zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DEFAULT_MIME = "application/octet-stream"
# MIME type -> converter; anything else goes to the text converter.
CONVERTERS = {"text/plain": "text", "text/html": "html", "text/csv": "csv",
              "text/markdown": "markdown", "text/mdx": "markdown", "application/pdf": "pdf"}
DEFAULT_CONVERTER = "text"
EXT_RE = r"\.([A-Za-z0-9]+)$"
# -----------------------------------------------------------------------------


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path segment ('' when none)."""
    last = F.regexp_extract(F.regexp_extract(path, r"^([^?#]*)", 1), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, EXT_RE, 1))


def mime_of(path: Column) -> Column:
    ext = extension(path)
    m = F.create_map(*[F.lit(x) for kv in EXT_MIME.items() for x in kv])
    return F.coalesce(F.element_at(m, ext), F.lit(DEFAULT_MIME))


def converter_of(mime: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CONVERTERS.items() for x in kv])
    return F.coalesce(F.element_at(m, mime), F.lit(DEFAULT_CONVERTER))
