"""Fill-in-the-middle transformation by displacement scatter.

A text is cut into prefix, middle and suffix at two token boundaries, and the
parts are written in another order behind the marks ``<P>``, ``<S>`` and
``<M>``. A batch of texts is one run of bytes. Its cuts are scanned from the
bytes; a difference array holds, at each cut, by how much the displacement of
the bytes changes there, and its cumulative sum is the place that every byte
moves to. One numpy scatter then writes all outputs of the batch. The way back
finds the marks in the outputs, builds the same displacements from them and
gathers the text with the inverse index.

Texts are UTF-8: white space and marks are ASCII bytes and cuts lie beside
them or at the ends of texts, so no character is ever split.

Scale: row-local Arrow passes, no shuffle. A batch is worked through in runs of
about ``RUN`` bytes (a longer text is a run of its own), so memory is a few
times the longest text at most, and a lost executor repeats only its own tasks.

Defined results: null texts count as empty ones (form plain, no tokens, empty
output); a null id hashes as the empty id; repeated rows are transformed one by
one, alike; an empty table gives an empty result; extra columns are dropped,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = (b"<P>", b"<S>", b"<M>")
SEED = 42
FIM_PERCENT = 50  # share of texts that are transformed
SPM_PERCENT = 80  # share of those in the order suffix, prefix, middle
FORMS = ("plain", "psm", "spm")
RUN = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def token_ends(flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, first): the token ends of all texts of a run, in order, and the
    number of the first end of each text (one more for the end of the last).

    A token is a run of other characters with the white space before it; white
    space at the end of a text is a token of its own.
    """
    size = len(flat)
    space = _SPACE[flat]
    last = np.zeros(size, dtype=bool)  # the last byte of a text
    last[start[1:][np.diff(start) > 0] - 1] = True
    ends = last.copy()
    ends[:-1] |= ~space[:-1] & space[1:]
    at = np.flatnonzero(ends) + 1
    return at, np.searchsorted(at, start, side="right")


def marked(flat: np.ndarray, mark: bytes) -> np.ndarray:
    """Positions at which a mark stands."""
    if len(flat) < 3:
        return np.zeros(0, dtype=np.int64)
    hit = (flat[:-2] == mark[0]) & (flat[1:-1] == mark[1]) & (flat[2:] == mark[2])
    return np.flatnonzero(hit)


def _inside(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Number of the text that each position lies in, -1 if a mark there runs over its end."""
    text = np.searchsorted(start, at, side="right") - 1
    return np.where(at + 3 <= start[text + 1], text, -1)


def displacement(size: int, start: np.ndarray, cut1: np.ndarray, cut2: np.ndarray, form: np.ndarray,
                 new: np.ndarray) -> np.ndarray:
    """Where every byte moves to: from a difference array over the cuts and its cumulative sum.

    ``start`` and ``new`` are the starts of the texts and of their outputs
    (with the end of the last); ``cut1`` and ``cut2`` end prefix and middle.
    """
    begin, end = start[:-1], start[1:]
    prefix, middle, suffix = cut1 - begin, cut2 - cut1, end - cut2
    psm, spm = form == 1, form == 2
    by = np.zeros((3, len(begin)), dtype=np.int64)  # displacement of each part
    by[0] = new[:-1] - begin + np.where(psm, 3, np.where(spm, 6 + suffix, 0))
    by[1] = new[:-1] - begin + np.where(psm, 9 + suffix, np.where(spm, 9 + suffix, 0))
    by[2] = new[:-1] - begin + np.where(psm, 6 - middle, np.where(spm, 3 - prefix - middle, 0))
    step = np.zeros(size + 1, dtype=np.int64)
    # parts in text order; each changes the displacement of the part before it
    place, value = np.stack([begin, cut1, cut2], 1).ravel(), by.T.ravel()
    np.add.at(step, place, np.diff(value, prepend=0))
    return np.cumsum(step[:size]) + np.arange(size)


def scatter(flat: np.ndarray, start: np.ndarray, cut1: np.ndarray, cut2: np.ndarray,
            form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of the outputs of a run of texts."""
    length = np.diff(start) + np.where(form > 0, 9, 0)
    new = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(int(new[-1]), dtype=np.uint8)
    out[displacement(len(flat), start, cut1, cut2, form, new)] = flat
    prefix, suffix = cut1 - start[:-1], start[1:] - cut2
    for k, places in ((1, (0, 3 + prefix, 6 + prefix + suffix)), (2, (3 + suffix, 0, 6 + prefix + suffix))):
        here = np.flatnonzero(form == k)
        for mark, place in zip(MARKS, places):
            at = new[here] + (place if np.isscalar(place) else place[here])
            for i, byte in enumerate(mark):
                out[at + i] = byte
    return out, new


def gather(flat: np.ndarray, start: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of the texts that a run of outputs was made from, from the outputs and forms alone."""
    begin, end, changed = start[:-1], start[1:], form > 0
    place = np.zeros((3, len(begin)), dtype=np.int64)  # where <P>, <S> and <M> stand
    for k, mark in enumerate(MARKS):
        at = marked(flat, mark)
        text = _inside(at, start) if len(at) else at
        here = (text >= 0) & changed[text] if len(at) else np.zeros(0, dtype=bool)
        if int(here.sum()) != int(changed.sum()):
            raise ValueError("a transformed text must hold each mark once")
        place[k, text[here]] = at[here]
    p, s, m = place
    prefix = np.where(form == 1, s - p - 3, np.where(form == 2, m - p - 3, 0))
    suffix = np.where(form == 1, m - s - 3, np.where(form == 2, p - s - 3, 0))
    length = end - begin - np.where(changed, 9, 0)
    old = np.concatenate([[0], np.cumsum(length)])
    cut1 = old[:-1] + prefix
    cut2 = np.where(changed, old[1:] - suffix, cut1)
    move = displacement(int(old[-1]), old, cut1, cut2, form, start)
    return flat[move], old


def _runs(offsets: np.ndarray, limit: int = RUN):
    """Consecutive texts (first, last) of about ``limit`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) \
        else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), at


def _strings(flat: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(start) - 1, [
        None, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.string())


def _hashes(column: pa.Array) -> np.ndarray:
    """First four 8-digit groups of each hex digest, as unsigned integers."""
    heads = "".join(h[:32] for h in column.to_pylist())
    return np.frombuffer(bytes.fromhex(heads), dtype=">u4").reshape(-1, 4).astype(np.int64)


def cut_run(flat: np.ndarray, start: np.ndarray, h: np.ndarray, fim_percent: int = FIM_PERCENT,
            spm_percent: int = SPM_PERCENT) -> dict[str, np.ndarray]:
    """Number of tokens, form and cuts of each text of a run."""
    begin, end = start[:-1], start[1:]
    at, first = token_ends(flat, start)
    n = np.diff(first)
    low, high = np.sort(np.stack([h[:, 0] % (n + 1), h[:, 1] % (n + 1)]), axis=0)
    ends = np.concatenate([at, [0]])

    def cut(units: np.ndarray) -> np.ndarray:
        return np.where(units > 0, ends[np.maximum(first[:-1] + units - 1, 0)], begin)

    held = np.zeros(len(n), dtype=bool)
    for mark in MARKS:
        hits = marked(flat, mark)
        text = _inside(hits, start) if len(hits) else hits
        held[text[text >= 0]] = True
    form = np.where(h[:, 3] % 100 < spm_percent, 2, 1)
    form[(end == begin) | held | (h[:, 2] % 100 >= fim_percent)] = 0
    return {"n": n, "form": form, "cut1": cut(low), "cut2": cut(high)}


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every text.

    The draws of a text come from the SHA-256 of ``seed:id``, so reruns agree.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = (f"`{id_col}` {dict(df.dtypes)[id_col]}, n long, form string, prefix_chars long, middle_chars long, "
              "output string")
    out = to_arrow_schema(_parse_datatype_string(schema))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)

    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column(1))
            for first, last in _runs(offsets):
                flat = data[offsets[first]:offsets[last]]
                start = offsets[first:last + 1] - offsets[first]
                cuts = cut_run(flat, start, _hashes(batch.column(2).slice(first, last - first)), fim_percent, spm_percent)
                form, cut1, cut2 = cuts["form"], cuts["cut1"], cuts["cut2"]
                made, new = scatter(flat, start, cut1, cut2, form)
                # code points: the bytes that do not continue a character
                points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80, dtype=np.int64)])
                plain = form == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(cuts["n"], pa.int64()),
                    pa.array([FORMS[k] for k in form.tolist()]),
                    pa.array(points[cut1] - points[start[:-1]], pa.int64(), mask=plain),
                    pa.array(points[cut2] - points[cut1], pa.int64(), mask=plain), _strings(made, new)], schema=out)

    return df.select(F.col(id_col), F.col(text_col), digest.alias("digest")).mapInArrow(run, schema)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """The columns of ``df`` and, as ``to``, the exact text that each output was made from.

    A null or unknown form counts as plain; a null output as an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(to, StringType())])
    out = to_arrow_schema(schema)
    at, kind = df.columns.index(output_col), df.columns.index(form_col)

    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column(at))
            for first, last in _runs(offsets):
                here = batch.slice(first, last - first)
                form = np.array([FORMS.index(x) if x in FORMS else 0 for x in here.column(kind).to_pylist()])
                text, old = gather(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], form)
                yield pa.RecordBatch.from_arrays([*here.columns, _strings(text, old)], schema=out)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``transform`` and ``restore`` with the digests of output and restored text in place of the texts."""
    made = restore(transform(df, id_col, text_col))
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM docs),
formed AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m,
         coalesce(array_to_string(u[hi + 1:], ''), '') AS s
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
