"""Quality rules, line first: judge every line, drop the failures, then reject
documents that lost too much text.

Line rules (a line without a word is neutral and stays):

* ``navigation``: at least two separators and one for every four words;
* ``symbols``: more than one symbol for every two words, at least three;
* ``shouting``: at least three words without a lower-case letter, or a double
  exclamation mark for every second word;
* ``repetition``: at least eight words, fewer than a third of them different;
* ``punctuation``: fewer than four words and no closing punctuation;
* ``boilerplate``: at most twelve words with a stock phrase.

Defined results: null text counts as an empty one; texts without words have
all counts 0, fail the base rules and are not kept; repeated rows are judged
one by one (row-local, no shuffle); very long texts are judged whole; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from corpuskit.llm.common import map_rows

# Characters counted as symbols, line separators, closing
# punctuation, stock phrases.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
CLOSING = tuple(".!?…:;,\"'”’»)]}。！？")
PHRASES = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy",
    "create an account", "enable javascript", "follow us", "forgot password", "home page",
    "leave a comment", "log in", "lorem ipsum", "next page", "previous page", "privacy policy",
    "read more", "share this", "sign in", "sign up", "skip to content", "subscribe now",
    "terms of service", "terms of use", "use cookies", "view all",
)

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: A document is rejected when its failing lines hold more than this share of its word characters.
MAX_LOST_PCT = 30
WINDOW = 8
_WS = " \t\n\v\f\r"


def failed_rule(line: str) -> str | None:
    """Name of the first rule a line fails, else None."""
    words = line.encode().split()
    n = len(words)
    if not n:
        return None
    separators = sum(line.count(c) for c in SEPARATORS)
    if separators >= 2 and separators * 4 >= n:
        return "navigation"
    symbols = sum(line.count(c) for c in SYMBOLS)
    if symbols >= 3 and symbols * 2 > n:
        return "symbols"
    if n >= 3 and line.isupper() or line.count("!!") * 2 >= n:
        return "shouting"
    if n >= 8 and len(set(words)) * 3 < n:
        return "repetition"
    if n < 4 and not line.rstrip(_WS).endswith(CLOSING):
        return "punctuation"
    if n <= 12:
        low = line.lower()
        if any(p in low for p in PHRASES):
            return "boilerplate"
    return None


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs twice or more.

    Exact: windows of 1, 2, 4 and 8 words get consecutive numbers by pairing
    the numbers of their halves (``window`` is a power of two).
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    span = 1
    while span < window:
        pair = ids[:-span] * np.int64(n + 1) + ids[span:]
        distinct, ids = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return 0
        span *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] >= 2)
    if not len(starts):
        return 0
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def judge(text: str | None, max_lost_pct: int = MAX_LOST_PCT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_failed_lines, lost_chars, cleaned text)."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = sum(text.count(c) for c in SYMBOLS)
    repeats = repeat_words(words)
    dup, failed, lost, seen, stay = 0, 0, 0, set(), []
    for line in text.split("\n"):
        if line.strip(_WS):
            if line in seen:
                dup += 1
            seen.add(line)
        if failed_rule(line):
            failed += 1
            lost += len(b"".join(line.encode().split()).decode())
        else:
            stay.append(line)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * n
    kept = not base and 100 * lost <= max_lost_pct * chars
    cleaned = "\n".join(stay) if failed else text
    return n, chars, symbols, dup, repeats, base, kept, failed, lost, cleaned


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_failed_lines long, lost_chars long")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            with_text: bool = False, max_lost_pct: int = MAX_LOST_PCT) -> DataFrame:
    """Counts and verdict per document; ``with_text`` adds the cleaned text."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, {RESULT}" + (", cleaned string" if with_text else "")

    def make() -> Callable:
        def row(key, text):
            got = judge(text, max_lost_pct)
            yield (key, *got) if with_text else (key, *got[:-1])
        return row

    return map_rows(df.select(id_col, text_col), schema, make)


def keep_clean(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
               max_lost_pct: int = MAX_LOST_PCT) -> DataFrame:
    """The kept documents with their cleaned texts, every other column as it was.

    ``chars_col`` (if there) is set to the length of the cleaned text when
    lines were removed.
    """
    from pyspark.sql import functions as F

    names = df.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = names.index(text_col)
            got = [judge(t, max_lost_pct) for t in batch.column(at).to_pylist()]
            keep = [i for i, g in enumerate(got) if g[6]]
            if not keep:
                continue
            part = batch.take(pa.array(keep, type=pa.int64()))
            cols = list(part.columns)
            cols[at] = pa.array([got[i][-1] for i in keep], type=batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = df.mapInArrow(run, df.schema)
    if chars_col and chars_col in names:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(df.schema[chars_col].dataType))
    return out
