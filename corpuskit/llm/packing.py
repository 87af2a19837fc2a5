"""Packing documents into fixed-length sequences, shortest pack first.

A document's token ids (an end id included) are cut into whole sequences and
one remainder. Whole sequences need no packing. Remainders are packed over the
histogram of their lengths: lengths are placed longest first, each time into
the shortest pack so far while it fits (pieces of one length share packs too),
moving counts between packing patterns, so the work depends on the number of lengths and not on the number
of documents. Remainders are then ranked within their length, and the rank
names the pattern's copy and the place in it.

Scale: documents are tokenised once, in a row-local pass that returns only
lengths and checksums of their pieces; texts are never shuffled. The histogram
has at most ``size`` lengths, whatever the input; the driver gets these counts
only. Ranks come from counts per (length, bucket): a length that holds most of
the rows is spread over all buckets, and no task orders a whole length.

Defined results: null text counts as an empty one and has the end id alone;
repeated rows are documents of their own; an empty table gives an empty
result; extra columns are not touched.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import map_rows, stored

SIZE = 4096
END = 2
#: Words, and parts of words, whose ids a task remembers.
REMEMBERED = 350_000


def token_ids(path: str | None = None) -> Callable[[str | None], bytes]:
    """Function from a text to its ids (little-endian unsigned 32-bit) under a
    ``tokenizers`` file: one like the public 49k word vocabulary (the default),
    which lower-cases, drops white space, and splits letters, digits and signs.

    No token crosses ASCII white space, so ids are found per word and
    remembered: words recur far more often than texts. A word of plain
    characters is split into its letter, digit and sign runs, which go to the
    BPE model one by one; any other word (apostrophes, ``<``, characters
    beyond Latin-1) goes through the whole tokenizer.
    """
    import os
    import re
    import struct

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    bpe = tokenizer.model.tokenize
    plain = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=-@\[-`{-~]+").fullmatch
    runs = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
    # byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    # others follow from 256 on, in order
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in same]
    alphabet = {b: 256 + i for i, b in enumerate(other)}

    def packed(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def run_word(run: str) -> bytes:
        if not run.isascii():  # printable ASCII stands for itself
            run = run.encode().decode("latin-1").translate(alphabet)
        return packed([t.id for t in bpe(run)])

    class Remembered(dict):
        def __init__(self, make):
            super().__init__()
            self.make = make

        def __missing__(self, key):
            got = self.make(key)
            if len(self) < REMEMBERED:
                self[key] = got
            return got

    run_ids = Remembered(run_word).__getitem__

    def word(key: bytes) -> bytes:
        w = key.decode()
        if plain(w):
            return b"".join(map(run_ids, runs(w.lower())))
        return packed(tokenizer.encode(w, add_special_tokens=False).ids)

    word_ids = Remembered(word).__getitem__

    def ids(text: str | None) -> bytes:
        return b"".join(map(word_ids, (text or "").encode().split()))

    return ids


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           size: int = SIZE, end: int = END) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): whole sequences and a remainder."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long"

    def make():
        ids = token_ids(tokenizer)

        def row(key, text):
            got = ids(text) + end.to_bytes(4, "little")
            for at in range(0, len(got), 4 * size):
                part = got[at:at + 4 * size]
                yield key, at // 4, len(part) // 4, zlib.crc32(part), len(got) // 4
        return row

    return map_rows(df.select(id_col, text_col), schema, make)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(count, lengths) of packs: lengths longest first, each into the shortest
    pack so far if it fits there, else into new ones: as few as hold the rest
    of the length, or one for each piece, whichever gives fewer packs."""
    return min((_filled(histogram, size, few) for few in (True, False)), key=lambda packs: sum(n for n, _ in packs))


def _filled(histogram: dict[int, int], size: int, few: bool) -> list[tuple[int, list[int]]]:
    open_packs: list[tuple[int, int]] = []  # heap of (filled, number)
    packs: list[list] = []  # count, lengths
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= size:
                filled, k = heapq.heappop(open_packs)
                count, lengths = packs[k]
                moved = min(count, left)
                if moved < count:  # the rest of this pattern stays as it is
                    packs[k][0] = count - moved
                    heapq.heappush(open_packs, (filled, k))
                    packs.append([moved, [*lengths, length]])
                    heapq.heappush(open_packs, (filled + length, len(packs) - 1))
                else:
                    lengths.append(length)
                    heapq.heappush(open_packs, (filled + length, k))
            else:
                moved = -(-left // (size // length)) if few else left
                packs.append([moved, [length]])
                heapq.heappush(open_packs, (length, len(packs) - 1))
            left -= moved
    return [(count, lengths) for count, lengths in packs]


def places(packs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): the remainders of a
    length from a rank on go to consecutive sequences from a first one."""
    rows, used, sequence = [], {}, 0
    for count, lengths in packs:
        at = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, at))
            used[length] = used.get(length, 0) + count
            at += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(found: DataFrame, id_col: str = "doc_id", size: int = SIZE, buckets: int = 256) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    rows = stored(found, "pieces")  # the tokenised pass runs once
    kept = rows.columns
    # a bucket of a length: by id and checksum, so that one length spreads out
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32", "doc_tokens"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(size, 0)  # whole sequences are full
    table = places(patterns(histogram, size))
    first = {int(x): i for i, x in reversed(list(enumerate(table[:, 0])))}
    packed = max(int(table[:, 2].max()) if len(table) else 0, 0) + sum(histogram.values())  # above any packed sequence
    # number of pieces of a length in earlier buckets
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
    order = Window.partitionBy("length", "bucket").orderBy(id_col, "start", "ids_crc32")
    ranked = rows.withColumn("at", F.row_number().over(order) - 1).join(
        before.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select(*kept, (F.col("before") + F.col("at")).alias("rank"))
    schema = ", ".join(f"{c} {k}" for c, k in ranked.select(*kept).dtypes) + ", sequence_id long, offset long"
    at = ranked.columns.index("length")
    last = {int(x): i + 1 for i, x in enumerate(table[:, 0])}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(len(kept)).to_numpy()
            sequence, offset = packed + rank, np.zeros_like(rank)
            for x in np.unique(length[length < size]).tolist():
                here = np.flatnonzero(length == x)
                own = table[first[x]:last[x]]
                k = np.searchsorted(own[:, 1], rank[here], side="right") - 1
                sequence[here] = own[k, 2] + rank[here] - own[k, 1]
                offset[here] = own[k, 3]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:len(kept)], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   size: int = SIZE, end: int = END, buckets: int = 256) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(pieces(df, id_col, text_col, tokenizer, size, end), id_col, size, buckets)
