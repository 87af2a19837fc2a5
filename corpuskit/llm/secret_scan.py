"""Secret scan: fixed patterns, and a token-efficiency test.

Random strings cost a byte-pair vocabulary many tokens: few characters per
token. Candidates are unbroken runs of key characters with letters and
digits; known digests (hexadecimal of a digest's length) and identifiers
(UUIDs, numbers, dates, paths and words joined by separators) are excluded
first, since they are random or dense but not secret.

Defined results: null text counts as an empty one; no span gives counts 0, the
digest of an empty string and an empty ``spans``; overlapping spans of
different kinds are all reported, but an added span that touches a base span
is not; repeated rows are scanned one by one (row-local, no shuffle); very long
texts are scanned whole; an empty table gives an empty result.

Not found: a run before or after ``@`` counts as part of an address, and a run
of letters alone as a word, so a password in ``://user:...@host`` and a random
key without a digit are left out unless a base pattern holds them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from corpuskit.llm.common import map_rows

# Base patterns (kind, pattern, checked group, least length).
BASE = (
    ("assign", re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
# the same matches: a run of 24 or more is the whole of a maximal run
_HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEYWORD = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_PARTS = re.compile(r"[-_/=+]+")
#: Characters per token below which a candidate counts as random.
MAX_RATIO = 2.2
KINDS = ("assign", "access", "hex", "token")


def _excluded(s: str) -> bool:
    """Known digests and identifiers."""
    if _UUID.fullmatch(s) or _HEX.fullmatch(s) and len(s) in DIGEST_LENGTHS:
        return True
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return True
    # words, numbers or single letters joined by separators: a path, slug or constant
    parts = [p for p in _PARTS.split(s) if p]
    return len(parts) > 1 and all(p.isdigit() or p.isalpha() and (p.islower() or p.isupper() or p.istitle())
                                  for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        if k == 0 and not _KEYWORD.search(text):
            continue
        if k == 1 and "AKIA" not in text:
            continue
        for m in (_HEX_RUN if k == 2 else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def token_spans(text: str, base: list[tuple[int, int, int]], encode: Callable[[str], list[int]],
                max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Added spans: low characters per token, exclusions apart."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        s = m.group().strip("=-_/+")
        if len(s) < 16 or _excluded(s) or any(x < b and a < y for x, _, y in base):
            continue
        if text[max(0, a - 3):a] == "://" or text[max(0, a - 1):a] == "@" or text[b:b + 1] == "@":
            continue
        if len(s) < max_ratio * len(encode(s)):
            out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """Encoder of a tiktoken rank file (default: the public 50k byte vocabulary)."""
    import base64

    import public_tokenizers as tokenizers
    import tiktoken

    with open(path or tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


def scan_text(text: str | None, encode: Callable, max_ratio: float = MAX_RATIO):
    """(base spans, all spans) of one text."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + token_spans(text, base, encode, max_ratio))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: counts per kind, digest of the base spans, spans."""
    schema = (f"{id_col} {dict(df.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, "
              "base_sha256 string, spans string, n_token long")

    def make():
        encode = encoder(vocabulary)

        def row(key, text):
            base, spans = scan_text(text, encode, max_ratio)
            n = [sum(k == j for _, k, _ in spans) for j in range(4)]
            yield (key, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3])
        return row

    return map_rows(df.select(id_col, text_col), schema, make)


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str = "[redacted]") -> str:
    """Spans replaced by a mark; overlapping spans become one. Of an assignment
    only the value goes (its key and sign stay readable)."""
    cut, out, at = [], [], 0
    for a, k, b in spans:
        if k == 0:
            a = a + BASE[0][1].match(text[a:b]).start(2)
        cut.append((a, b))
    for a, b in sorted(cut):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
           vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Every row with its secrets replaced; rows and other columns stay.

    ``chars_col`` (if there) is set to the length of the new text.
    """
    from pyspark.sql import functions as F

    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        encode = encoder(vocabulary)
        for batch in batches:
            new = []
            for t in batch.column(at).to_pylist():
                spans = scan_text(t, encode, max_ratio)[1]
                new.append(redact_text(t, spans) if spans else t)
            cols = list(batch.columns)
            cols[at] = pa.array(new, type=batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = df.mapInArrow(run, df.schema)
    if chars_col and chars_col in df.columns:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(df.schema[chars_col].dataType))
    return out
