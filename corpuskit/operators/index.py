"""Stored search index: chunk rows, postings laid out by term, collection counts.

An ingest writes it once to a shared folder; every search reads the written
tables, so no query cleans, chunks or tokenises the corpus again.

Layout
------
* ``blocks``: one row per (term, range) with the postings of the term in that
  range of chunks, and what gives their maximal weight: the shortest chunk of
  each term frequency (so the maximum stays exact whatever the average length
  becomes). The table is partitioned on disk by ``part``, a hash of the term,
  and sorted by term inside a file (a few files a part, however large the collection): a search reads the parts of its terms only
  (a partition filter), and the maxima without the postings (column pruning).
* A range is a hash of runs of ``RUN`` consecutive chunks of a file, ``RANGE`` to
  ``MOST_RANGE`` chunks in all (a term has at most one block a range, so wide ranges
  keep the blocks of a large collection few), so all terms share the ranges, the chunks of one
  file stay together, and a giant file or a term that stands in most chunks is
  still spread over many blocks.
* ``terms``: term, part, df. ``stats``: one row, n_docs and avgdl.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.text import tokens
from corpuskit.operators.packed import as_lists, pack, text_hash, unpack
from corpuskit.session import shuffles_dropped

RANGE = 32          # chunks a range, on average, of a small collection
MOST_RANGE = 4096    # and of a large one
LEAST_RANGES = 64    # ranges before they become wider than RANGE
RUN = 32            # consecutive chunks of a file that share a range
PART_CHUNKS = 4096   # chunks a term part, on average
MOST_PARTS = 4096
TASKS = 4            # tasks that put ranges together, in times of the shuffle partitions
FREQUENT = 16        # a term is frequent if it stands in more than one of so many chunks of a range
MOST_OPEN = 1_000_000  # postings of the blocks that a task has unpacked at a time, about
SLICE_CHUNKS = 1_000_000  # chunks whose postings of frequent terms are written by one task, on average

ENTRY = "entry_"     # before the names of the lists that hold the entries of a block
TOPS = ("top_tf", "top_dl")


@dataclass(frozen=True)
class SearchIndex:
    """``chunks``: the chunk rows and their ``range``. ``blocks``: part, term, range, n, n_tokens,
    tops (tf, dl), n_first, dl_first, entries (keys, dl, tf), and the lists that ``tops`` and ``entries`` are stored as
    (``TOPS``, ``ENTRY``). ``parts``: number of term parts. ``width``: chunks a range, on average."""

    chunks: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    parts: int
    ranges: int
    width: int

    @property
    def postings(self) -> DataFrame:
        """One row per posting: term, part, range, keys..., dl, tf."""
        return self.blocks.select("term", "part", "range", F.inline("entries"))


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(term, F.lit(""))), F.lit(parts)).cast("int")


def range_of(file: Column, chunk_index: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(file, F.floor(chunk_index / RUN)), F.lit(ranges)).cast("int")


def block_rows(rows: DataFrame, keys: list[str], deal: Callable[[np.ndarray, int, np.ndarray], np.ndarray],
               text_col: str = "content") -> DataFrame:
    """Packs (``operators.packed``) of blocks of chunk rows (keys..., range, text); ``opened`` has their rows.

    A range is put together where its chunks meet: their texts are shuffled, not a row for each (chunk, term),
    and the postings of a term and range leave their task as one block, all blocks of a range for one receiver as
    one row. A chunk without tokens has an entry under a null term; ``n_first`` counts each chunk on one of its
    entries. ``deal``: (hashes of terms, range, which of the terms are frequent) -> receivers.
    A term is frequent if many chunks of the range have it; it decides where a block is written, nothing else.
    """
    def made(table: pa.Table) -> pa.Table:
        tokens_of = table["tokens"].combine_chunks()
        size_of = pc.fill_null(pc.list_value_length(tokens_of), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = len(size_of)
        flat = pc.list_flatten(tokens_of).dictionary_encode()
        words = flat.dictionary
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * chunks + np.repeat(np.arange(chunks), size_of)
        pair, tf = np.unique(code, return_counts=True)  # by term, then chunk
        term, row = np.divmod(pair, chunks)
        empty = np.flatnonzero(size_of == 0)
        term = np.concatenate([term, np.full(len(empty), len(words))])
        row = np.concatenate([row, empty])
        tf = np.concatenate([tf, np.ones(len(empty), dtype=np.int64)])
        dl = size_of[row]
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(begin, len(term))
        size = np.diff(ends)
        chosen = np.zeros(chunks, dtype=np.int64)
        chosen[row] = np.arange(len(row))  # one entry of each chunk
        first = np.zeros(len(term), dtype=bool)
        first[chosen] = True
        # the shortest chunk of each term frequency of a block
        most_tf, most_dl = int(tf.max()) + 1, int(dl.max()) + 1
        top = np.sort((np.repeat(np.arange(len(begin)), size) * most_tf + tf) * most_dl + dl)
        top = top[np.diff(top // most_dl, prepend=-1) != 0]
        top_block, top_tf = np.divmod(top // most_dl, most_tf)
        tops = np.concatenate([[0], np.cumsum(np.bincount(top_block, minlength=len(begin)))])
        names = pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())]).take(pa.array(term[begin]))
        at = pa.array(row)
        number = table["range"][0].as_py()
        of_word = np.append(text_hash(words), 0)[term[begin]]
        int32 = lambda x: pa.array(x, pa.int32())
        own = {"term": names, "range": int32(np.full(len(begin), number)), "n_tokens": int32(np.add.reduceat(tf, begin)),
               "n_first": int32(np.add.reduceat(first.astype(np.int64), begin)),
               "dl_first": int32(np.add.reduceat(np.where(first, dl, 0), begin))}
        entries = {f"{ENTRY}{c}": table[c].combine_chunks().take(at) for c in keys}
        out = pack(deal(of_word, number, size * FREQUENT > chunks), own, {
            "n": (size, entries | {f"{ENTRY}dl": int32(dl), f"{ENTRY}tf": int32(tf)}),
            "n_tops": (np.diff(tops), {c: int32(x) for c, x in zip(TOPS, (top_tf, top % most_dl))})})
        return pa.Table.from_batches([out])

    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("range", *keys, text_col).repartition(TASKS * shuffled, "range").sortWithinPartitions("range")
    met = met.select("range", *keys, tokens(text_col).alias("tokens"))  # texts cross the network, not their tokens
    return met.groupBy("range").applyInArrow(made, "to int, data binary")


def opened(packs: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """Blocks (term, range, n, n_tokens, n_first, dl_first, a list for each of ``TOPS`` and of keys, dl and tf) of their packs."""
    lists = {**{c: "int" for c in TOPS}, **{f"{ENTRY}{c}": kinds[c] for c in keys}, **{f"{ENTRY}{c}": "int" for c in ("dl", "tf")}}
    schema = ", ".join(["term string, range int, n long, n_tokens long, n_first long, dl_first long",
                        *[f"{c} array<{kind}>" for c, kind in lists.items()]])

    def run(batches):
        for batch in batches:
            for x in unpack(batch.column(1), MOST_OPEN):
                out = {c: x[c] for c in ("term", "range")} | {c: x[c].cast(pa.int64()) for c in ("n", "n_tokens", "n_first", "dl_first")}
                out |= {c: as_lists(x["n_tops" if c in TOPS else "n"], x[c]) for c in lists}
                yield pa.RecordBatch.from_pydict(out)

    return packs.select("to", "data").mapInArrow(run, schema)


def write_index(chunks: DataFrame, folder: str, keys: list[str], chunk_index: str = "chunk_index",
                file: str = "source_filename") -> SearchIndex:
    """Write the index of ``chunks`` into ``folder``; each table is made from the written one before it."""
    spark = chunks.sparkSession

    def stored(name: str, df: DataFrame, *by: str) -> DataFrame:
        with shuffles_dropped(spark):
            df.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    plain = stored("chunks", chunks)
    n = plain.count()
    width = min(MOST_RANGE, max(RANGE, n // LEAST_RANGES))
    ranges = max(1, -(-n // width))
    parts = min(MOST_PARTS, max(8, -(-n // PART_CHUNKS)))
    rows = plain.withColumn("range", range_of(F.col(file), F.col(chunk_index), ranges))

    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A cell is what one task writes of a part: all of it when there are more parts than tasks, the terms
    # of one hash otherwise. Only terms that stand in many chunks are cut further, by range, so the number
    # of files grows with the number of parts, not with its square.
    own, slices = max(1, -(-2 * shuffled // parts)), max(1, -(-n // SLICE_CHUNKS))
    tasks = max(shuffled, min(parts * own * slices, 2 * shuffled))  # a range has a pack for each

    def deal(hashes: np.ndarray, number: int, frequent: np.ndarray) -> np.ndarray:
        cell = (hashes % parts * own + hashes // parts % own) * slices + np.where(frequent, number % slices, 0)
        return cell % tasks

    dealt = block_rows(rows, keys, deal).repartition(tasks, "to")
    made = opened(dealt, keys, dict(rows.dtypes)).withColumn("part", part_of(F.col("term"), parts))
    blocks = stored("blocks", made.sortWithinPartitions("part", "term", "range"), "part")
    blocks = blocks.withColumn("tops", F.arrays_zip(*[F.col(c).alias(c.removeprefix("top_")) for c in TOPS])).withColumn(
        "entries", F.arrays_zip(*[F.col(f"{ENTRY}{c}").alias(c) for c in (*keys, "dl", "tf")]))
    terms = blocks.filter(F.col("term").isNotNull()).groupBy("part", "term").agg(F.sum("n").alias("df"))
    terms = stored("terms", terms.select("term", "df", "part").repartition("part"), "part")
    stats = stored("stats", blocks.agg(F.sum("n_first").alias("n_docs"), (F.sum("dl_first") / F.sum("n_first")).alias("avgdl")))
    return SearchIndex(rows, blocks, terms, stats, parts, ranges, width)


def source_version(spark: SparkSession, path: str) -> tuple:
    """What tells a changed source from the one indexed: number, size, newest change
    and outer names of its files, from their listing alone (no file is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return tuple(files.agg(F.count("path"), F.sum("length"), F.max("modificationTime"), F.min("path"), F.max("path")).first())
