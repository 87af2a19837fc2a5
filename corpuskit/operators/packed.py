"""Rows that cross the network in packs: one row for all that a batch has for one receiver.

Narrow rows (a posting, a token) cost more in row headers and padded values than in
what they say. A pack is a record batch of one row whose columns are lists, compressed;
it is one binary value for Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PACKED = pa.schema([("to", pa.int32()), ("data", pa.binary())])

def text_hash(texts: pa.Array) -> np.ndarray:
    """CRC-32 of each text (0: null), as Spark's ``crc32``."""
    return np.array([zlib.crc32(x or b"") for x in texts.cast(pa.binary()).to_pylist()], dtype=np.int64)


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``at[i]``, ``at[i] + 1``, ... of each list, ``size[i]`` of them."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


def dealt_order(to: np.ndarray) -> np.ndarray:
    """Places of the rows by receiver (numbers from 0), their order kept."""
    return np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")


def pack(to: np.ndarray, own: dict[str, pa.Array], lists: dict[str, tuple[np.ndarray, dict[str, pa.Array]]]) -> pa.RecordBatch:
    """(to, data): the rows dealt by ``to``, their order kept. ``own``: columns with a value a row. ``lists``: name ->
    (values a row, columns of these values); the numbers of values are packed under the name."""
    order = dealt_order(to)
    begin = np.flatnonzero(np.diff(to[order], prepend=-1))
    cut = [np.append(begin, len(to))] * len(own)
    columns = {c: x.take(pa.array(order)) for c, x in own.items()}
    for name, (size, values) in lists.items():
        at, size = (np.cumsum(size) - size)[order], size[order]
        columns[name] = pa.array(size, pa.int32())
        inside = np.append((np.cumsum(size) - size)[begin], size.sum())
        taken = pa.array(spread(at, size))
        columns |= {c: x.take(taken) for c, x in values.items()}
        cut += [np.append(begin, len(to)), *[inside] * len(values)]
    schema = pa.schema([(c, pa.list_(x.type)) for c, x in columns.items()])
    data = []
    for i in range(len(begin)):
        row = [pa.ListArray.from_arrays(pa.array([0, b[i + 1] - b[i]], pa.int32()), x.slice(b[i], b[i + 1] - b[i]))
               for b, x in zip(cut, columns.values())]
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays(row, schema=schema))
        data.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(to[order][begin], pa.int32()), pa.array(data, pa.binary())], schema=PACKED)


def unpack(data, most: int | None = None) -> Iterator[dict[str, pa.Array]]:
    """The columns of the packs, several packs together: all, or until a column has ``most`` values."""
    held, n = [], 0
    for x in data:
        row = pa.ipc.open_stream(x.as_buffer()).read_next_batch()
        held.append(row)
        n += max(len(c.values) for c in row.columns)
        if most and n >= most:
            yield _together(held)
            held, n = [], 0
    if held:
        yield _together(held)


def _together(rows: list[pa.RecordBatch]) -> dict[str, pa.Array]:
    return {c: pa.concat_arrays([pc.list_flatten(r.column(c)) for r in rows]) for c in rows[0].schema.names}


def as_lists(size: pa.Array, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size.to_numpy())]), pa.int32()), values)
