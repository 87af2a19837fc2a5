"""Token counts per section, attributed by offsets.

A document is encoded once, as a whole; every token's span follows from the
lengths of the tokens before it. Spans are then joined to the sections (the
lines of the text, each with its line feed, so that sections cover the text).

Rule for a token that crosses a boundary: it counts for the section that holds
its first character other than ASCII white space; a token of white space alone
counts for the section of its first character. Every token so counts exactly
once, and a document's sections sum to its tokens. Spans are compared in UTF-8
bytes, since a token may end inside a character; results are in code points.

Defined results: null and empty texts have one empty section with 0 tokens;
repeated rows are counted one by one (row-local, no shuffle); a very long text
is encoded whole; an empty table gives an empty result; extra columns are not
touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpuskit.llm.common import map_rows


def attributor(path: str | None = None):
    """Function from a text to its sections' (start, end, tokens, crossing),
    under a tiktoken rank file (default: the public 50k byte vocabulary)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                               special_tokens={}).encode_ordinary
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    lead = np.zeros_like(length)
    for token, k in ranks.items():
        length[k] = len(token)
        lead[k] = len(token) - len(token.lstrip()) if token.strip() else 0

    def sections(text: str | None) -> list[tuple[int, int, int, int]]:
        text = text or ""
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        ends = np.cumsum([len(x.encode()) for x in lines])
        ids = np.array(encode(text), dtype=np.int64)
        stop = np.cumsum(length[ids])
        start = stop - length[ids]
        # a section holds the positions before its end and from the one before on
        owner = np.searchsorted(ends, start + lead[ids], side="right")
        crossing = np.searchsorted(ends, start, side="right") != np.searchsorted(ends, stop - 1, side="right")
        n = np.bincount(owner, minlength=len(lines))
        split = np.bincount(owner[crossing], minlength=len(lines))
        out, at = [], 0
        for line, a, b in zip(lines, n.tolist(), split.tolist()):
            out.append((at, at + len(line), a, b))
            at += len(line)
        return out

    return sections


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing, doc_tokens), a row per section.

    ``n_crossing`` counts the section's tokens that also cover characters of
    another section.
    """
    schema = (f"{id_col} {dict(df.dtypes)[id_col]}, section long, start long, end long, n_tokens long, "
              "n_crossing long, doc_tokens long")

    def make():
        sections = attributor(vocabulary)

        def row(key, text):
            got = sections(text)
            total = sum(s[2] for s in got)
            for k, (a, b, n, crossing) in enumerate(got):
                yield key, k, a, b, n, crossing, total
        return row

    return map_rows(df.select(id_col, text_col), schema, make)
