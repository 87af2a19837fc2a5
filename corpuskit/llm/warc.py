"""WARC archives: written from pages, read back, assembled to captures.

A page is written as a transaction of three records: a request, a response (or,
if another page has the same payload, a revisit) and a metadata record. Request
and metadata name the response in ``WARC-Concurrent-To``. ``assemble`` joins
records of any archive through these identifiers, in whichever direction they
point, and emits one nested row per capture.

* Writing: records are text (header, block) and every record ends in an empty
  line, so Spark's text writer writes the archives, gzip-compressed, at most
  ``records_a_file`` records each; a task that is lost is written again whole.
  Equal payloads are found from (digest, id) alone: only these small rows meet
  on the digest. Pages meet the list of revisits on (id, digest), so one
  payload that very many pages share never gathers their texts in a task.
* Reading: Spark's text reader cuts the files at ``WARC/1.``; a row-local pass
  puts the pieces of a record together again by its ``Content-Length``, so a
  payload may hold that mark or whole records. Compressed files are read by
  one task each and in order, with one record in memory; plain files could be
  split amid a record and are refused (``.gz`` only).
* Assembly: partial aggregates with a bounded state (``min_by`` and counts), so
  a capture with very many records is safe; ``linked`` has every one of them.

Defined results: null html is an empty payload; null or unprintable addresses
are left out or percent-encoded in headers; a page without an id is a response
of its own; rows that repeat the id and payload of a response are responses
too; equal payloads below ``least_bytes`` are all responses; a record that ends
before its length is marked ``complete = false``; an empty table writes no
records and gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import checkpoint_dir, stored

# Signs of the format.
SEPARATOR = "WARC/1."
CRLF = "\r\n"
LEAST_BYTES = 1000
RECORDS_A_FILE = 30_000
#: No header of a record is longer.
MOST_HEADER = 1 << 20

_RECORD = ("file string, number long, type string, record_id string, concurrent_to array<string>, refers_to string, "
           "target_uri string, date string, content_type string, profile string, status int, "
           "fields map<string,string>, payload_bytes long, payload_digest string, complete boolean")


# ------------------------------------------------------------------- writing

def _record(kind: str, rid: Column, block: Column, *headers: Column) -> Column:
    """A record without the empty line at its end (headers that are null are left out)."""
    return F.concat(
        F.concat_ws(CRLF, F.lit(f"{SEPARATOR}1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid),
                    F.date_format(F.current_timestamp(), "'WARC-Date: 'yyyy-MM-dd'T'HH:mm:ss'Z'"), *headers,
                    F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))),
        F.lit(CRLF * 2), block)


def keyed(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(pages with digest and bytes, (id, digest, head) of the pages that revisit ``head``)."""
    rows = pages.select("*", F.sha1(F.col("_html").cast("binary")).alias("_digest"),
                        F.octet_length("_html").cast("long").alias("_bytes"))
    keys = rows.filter(F.col("_bytes") >= least_bytes).select("_id", "_digest")
    heads = keys.groupBy("_digest").agg(F.max("_id").alias("_head"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows, keys.join(heads, "_digest").filter(F.col("_id") != F.col("_head"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record): the text of every record of every page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"))
    rows, again = keyed(pages, least_bytes)
    again = stored(again.select("_id", "_digest").distinct(), "revisits")  # read by both branches
    keys = ["_id", "_digest"]
    first = rows.join(again, keys, "left_anti").select("_id", "_url", "_digest", "_bytes", "_html", F.lit(False).alias("_again"))
    later = rows.drop("_html").join(again, keys, "left_semi").select(
        "_id", "_url", "_digest", "_bytes", F.lit("").alias("_html"), F.lit(True).alias("_again"))
    # one identifier a page and record, drawn before the records are made of it
    named = first.unionByName(later).select("*", *[F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias(x) for x in "qrm"])
    url = F.when(F.col("_url").rlike(r"[\x00-\x20\x7F]"), F.url_encode("_url")).otherwise(F.col("_url"))
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    to = F.concat(F.lit("WARC-Concurrent-To: "), F.col("r"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("FILE")), F.lit("")), F.lit("/"))
    host = F.concat(F.lit("Host: "), F.try_parse_url(url, F.lit("HOST")))
    request = F.concat(F.concat_ws(CRLF, F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1")), host), F.lit(CRLF * 2))
    fields = F.concat_ws("", F.concat(F.lit("page_id: "), F.col("_id").cast("string"), F.lit(CRLF)))
    http = [F.lit(f"Content-Type: application/http; msgtype={x}") for x in ("request", "response")]
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    made = F.array(
        _record("request", F.col("q"), request, target, to, http[0]),
        F.when(F.col("_again"), _record("revisit", F.col("r"), head, target, digest, profile, http[1]))
        .otherwise(_record("response", F.col("r"), F.concat(head, F.col("_html")), target, digest, http[1])),
        _record("metadata", F.col("m"), fields, target, to, F.lit("Content-Type: application/warc-fields")))
    return named.select(F.explode(made).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = LEAST_BYTES, records_a_file: int = RECORDS_A_FILE) -> None:
    """Gzip archives of all pages in the folder ``path``."""
    records(pages, id_col, url_col, html_col, least_bytes).write.option("lineSep", CRLF * 2).option(
        "compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


# ------------------------------------------------------------------- reading

def joined(pieces: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, int, bytes, bytes, bool]]:
    """(file, number, header, block, complete) of the records of archives cut at ``SEPARATOR``.

    The first piece of a file is what stands before its first mark. A record
    takes pieces until it has its header and as many bytes as that states.
    """
    mark = SEPARATOR.encode()
    file, number, parts, have, need, at = None, 0, [], 0, None, 0

    def made(whole: bool):
        data = b"".join(parts)
        if need is None:
            return file, number, data[:MOST_HEADER], b"", False
        return file, number, data[:at], data[at + 4:need], whole

    for name, piece in pieces:
        if name != file:
            if parts:
                yield made(False)
            file, number, parts, have, need = name, 0, [], 0, None
            continue
        if parts:
            parts += [mark, piece]
            have += len(mark) + len(piece)
        else:
            parts, have, need = [piece], len(piece), None
        if need is None:
            head = b"".join(parts)
            parts = [head]
            at = head.find(b"\r\n\r\n")
            if at >= 0:
                stated = re.search(rb"(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$", head[:at])
                need = at + 4 + (int(stated[1]) if stated else 0)
            elif have > MOST_HEADER:  # no record: the rest up to the next mark is left out
                yield made(False)
                number, parts = number + 1, []
                continue
        if need is not None and have >= need:
            yield made(True)
            number, parts = number + 1, []
    if parts:
        yield made(False)


def _headers(head: bytes) -> list[tuple[str, str]]:
    """Names (lower case) and values; a line that starts with white space goes on the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    return [(name.strip().lower(), value.strip()) for name, sep, value in (x.partition(":") for x in lines) if sep]


def _hex_digest(value: str | None) -> str | None:
    """A SHA-1 digest as bare lower-case hex, whether written in hex or base 32."""
    kind, _, code = (value or "").rpartition(":")
    if kind.lower() not in ("", "sha1"):
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", code):
        return code.lower()
    return base64.b32decode(code.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", code) else None


def record_row(file: str, number: int, head: bytes, block: bytes, complete: bool) -> tuple[dict, bytes | None]:
    """Columns of a record, and its payload (null for revisits, whose payload is another record's)."""
    named = _headers(head)
    header = dict(reversed(named))  # the first of a name counts
    kind, content = header.get("warc-type"), header.get("content-type") or ""
    body, fields, status, size, digest = block, None, None, None, None
    if content.lower().startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        http = dict(reversed(_headers(top)))
        said = re.match(rb"HTTP/[0-9.]+ ([0-9]{3})\b", top)
        status = int(said[1]) if said else None
        size = int(http["content-length"]) if re.fullmatch("[0-9]{1,18}", http.get("content-length", "")) else None
    elif content.lower().startswith("application/warc-fields"):
        fields = dict(reversed(_headers(block)))
    if kind == "revisit":
        body, digest = None, _hex_digest(header.get("warc-payload-digest"))
    else:
        size, digest = len(body), hashlib.sha1(body).hexdigest()
    return {"file": file, "number": number, "type": kind, "record_id": header.get("warc-record-id") or f"{file}#{number}",
            "concurrent_to": [v for k, v in named if k == "warc-concurrent-to"], "refers_to": header.get("warc-refers-to"),
            "target_uri": header.get("warc-target-uri"), "date": header.get("warc-date"),
            "content_type": header.get("content-type"), "profile": header.get("warc-profile"), "status": status,
            "fields": list(fields.items()) if fields is not None else None, "payload_bytes": size,
            "payload_digest": digest, "complete": complete}, body


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the gzip archives in ``path``; ``payload`` only if asked for."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _RECORD + (", payload binary" if payloads else "")
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        pieces = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows, size = [], 0
        for found in joined(pieces):
            row, body = record_row(*found)
            if payloads:
                row["payload"] = body
                size += len(body or b"")
            rows.append(row)
            if len(rows) >= 10_000 or size >= 16 << 20:
                yield pa.RecordBatch.from_pylist(rows, out)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, out)

    pieces = spark.read.option("lineSep", SEPARATOR).option("pathGlobFilter", "*.gz").text(path)
    return pieces.select("_metadata.file_path", F.col("value").cast("binary")).mapInArrow(run, schema)


# ------------------------------------------------------------------ assembly

HEADS = ("response", "revisit", "resource", "conversion")


def linked(records: DataFrame) -> DataFrame:
    """(capture_id, role, record): every record with the captures it belongs to.

    A response (or revisit, resource, conversion) heads a capture of its own;
    requests and metadata belong to the captures that they name, and to those
    that name them; others to none, so their own identifier stands for one.
    """
    whole = F.struct(*records.columns).alias("record")
    role = F.when(F.col("type").isin(*HEADS), "head").when(F.col("type") == "request", "request") \
        .when(F.col("type") == "metadata", "metadata").otherwise("other")
    rows = records.select("record_id", "concurrent_to", role.alias("role"), whole)
    heads = rows.filter("role = 'head'").select(F.col("record_id").alias("capture_id"), "role", "record")
    parts = rows.filter("role <> 'head'")
    own = parts.select(F.explode("concurrent_to").alias("capture_id"), "role", "record")
    named = records.filter(F.col("type").isin(*HEADS)).select(
        F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")).distinct()
    other = parts.join(named, "record_id", "left").filter(
        F.col("capture_id").isNotNull() & ~F.array_contains("concurrent_to", F.col("capture_id"))
        | F.col("capture_id").isNull() & (F.size("concurrent_to") == 0))
    return heads.unionByName(own).unionByName(
        other.select(F.coalesce("capture_id", "record_id").alias("capture_id"), "role", "record"))


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, response, request, metadata, n_requests, n_metadata): a nested row per capture.

    ``response`` is null where only other records name the capture; of several
    requests or metadata records the one with the least identifier is nested.
    """
    def first(role: str) -> Column:
        return F.min_by(F.when(F.col("role") == role, F.col("record")),
                        F.when(F.col("role") == role, F.col("record.record_id")))

    return linked(records).groupBy("capture_id").agg(
        first("head").alias("response"), first("request").alias("request"), first("metadata").alias("metadata"),
        F.count_if(F.col("role") == "request").alias("n_requests"), F.count_if(F.col("role") == "metadata").alias("n_metadata"))


def with_payloads(captures: DataFrame) -> DataFrame:
    """``captures`` and the payload of each, for revisits that of the response with the same digest (null if none)."""
    later = F.coalesce(F.col("response.type") == "revisit", F.lit(False))
    known = captures.filter(F.col("response.type") == "response").groupBy(
        F.col("response.payload_digest").alias("_digest")).agg(F.any_value("response.payload").alias("payload"))
    return captures.filter(~later).withColumn("payload", F.col("response.payload")).unionByName(
        captures.filter(later).join(known, F.col("response.payload_digest") == F.col("_digest"), "left").drop("_digest"))


def page_rows(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures of ``write_archives``.

    A revisit's page is that of the response with the same payload digest.
    """
    page = F.try_element_at(F.col("metadata.fields"), F.lit("page_id")).cast("long")
    rows = captures.select(page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
                           F.col("response.payload_digest").alias("payload_digest"),
                           F.col("response.type").alias("record_type"))
    heads = rows.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"))
    later = rows.filter("record_type = 'revisit'").join(heads, "payload_digest", "left")
    return rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(later)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder, reads and assembles them, and returns ``page_rows``."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpuskit-warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    found = stored(read_records(spark, path, payloads=False), "records")  # archives are read once
    captures = stored(assemble(found), "captures")
    return page_rows(captures)


#: The same rows in DuckDB SQL.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
