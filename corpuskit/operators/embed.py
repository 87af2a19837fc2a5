"""Corpus-fitted embedder (#33): hashed terms weighted by their rarity.

``fit`` turns the document counts of the terms into weights,
``ln((1 + N) / (1 + df)) + 1``, once for a collection; the table is stored and
used for chunks and queries alike, so their vectors can be compared. A term adds
``tf * weight`` to one of ``dim`` places, with a sign; place and sign come from
the term's MD5, so any engine gets the same vectors. Vectors have length 1.

Scale: term counts are packed (``operators.packed``) and dealt by term to the weights,
then dealt by row and summed there; a task unpacks about ``PACK`` of them at a time.
Terms that the collection lacks add nothing; a row without any known term has the
zero vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import tokens
from corpuskit.operators.packed import PACKED, dealt_order, pack, text_hash, unpack

DIM = 64
PACK = 1_000_000  # counts that a task holds unpacked at a time, about


def place(term: Column, dim: int) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim


def sign(term: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(term), 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def fit(terms: DataFrame, n_docs: Column, dim: int = DIM) -> DataFrame:
    """(term, place, weight) of a table (term, df); the sign is in the weight."""
    rarity = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    return terms.select("term", place(F.col("term"), dim).alias("place"), (sign(F.col("term")) * rarity).alias("weight"))


def _key_hash(columns: list[pa.Array]) -> np.ndarray:
    """A hash of each key, the same in every table (whole numbers by value, all else by its text)."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        if pa.types.is_integer(c.type):
            own = pc.fill_null(c.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
        else:
            coded = c.cast(pa.string()).dictionary_encode()
            own = np.append(text_hash(coded.dictionary), 0)[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)].astype(np.uint64)
        out = (out ^ own) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _codes(known: list[pa.Array], columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys that differ in ``known``, code of each key of ``known``, of ``columns``; -1: none, or a null in it)."""
    one, two = np.zeros(len(known[0]), dtype=np.int64), np.zeros(len(columns[0]), dtype=np.int64)
    for a, b in zip(known, columns):
        values = a.unique().drop_null()
        i, j = (pc.fill_null(pc.index_in(x.cast(a.type), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        one, two = (np.where((x < 0) | (k < 0), -1, x * len(values) + k) for x, k in ((one, i), (two, j)))
        seen = np.append(np.unique(one[one >= 0]), np.iinfo(np.int64).max)  # numbered anew, so the codes stay small
        one, two = (np.where(seen[at] == x, at, -1) for x, at in ((x, np.searchsorted(seen, x)) for x in (one, two)))
    return np.unique(one[one >= 0]), one, two


def embed_terms(rows: DataFrame, counts: DataFrame, fitted: DataFrame, keys: list[str], dim: int = DIM,
                out_col: str = "embedding") -> DataFrame:
    """``rows`` (their keys) with the vector of their terms in ``counts`` (keys, term, tf), where keys and tf may be
    lists of a term's.

    The counts cross the network twice in packs, a few bytes each: to the weight of their term, and from there, by runs
    that share a term, to their row.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds, listed = dict(counts.dtypes), [*keys, "tf"]
    lists = counts.filter(F.col("term").isNotNull()).select(
        "term", *[c if kinds[c].startswith("array") else F.array(c).alias(c) for c in listed])

    def by_term(batches):
        def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            size = pc.list_value_length(table["tf"]).to_numpy().astype(np.int64)
            values = {c: pc.list_flatten(table[c]).combine_chunks() for c in listed}
            term = table["term"].combine_chunks()
            return pack(text_hash(term) % n, {"term": term}, {"size": (size, values)})

        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += pc.sum(pc.list_value_length(batch.column(1))).as_py() or 0
            if many >= PACK:
                yield dealt(held)
                held, many = [], 0
        if many:
            yield dealt(held)

    def weighted(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [PACKED.empty_table()]
        terms = right["term"].combine_chunks()
        places, weights = right["place"].to_numpy(), right["weight"].to_numpy()
        for x in unpack(left["data"], PACK):
            at = pc.fill_null(pc.index_in(x["term"], value_set=terms), -1).to_numpy(zero_copy_only=False)
            block = np.repeat(at, x["size"].to_numpy())
            to = (_key_hash([x[c] for c in keys]) % np.uint64(n)).astype(np.int64)
            order = dealt_order(to)  # the counts of a term stay together
            order = order[block[order] >= 0]
            block, to = block[order], to[order]
            begin = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(to, prepend=-1) != 0))
            own = {"place": pa.array(places[block[begin]]), "weight": pa.array(weights[block[begin]])}
            values = {c: x[c].take(pa.array(order)) for c in listed}
            found.append(pa.Table.from_batches([pack(to[begin], own, {"size": (np.diff(np.append(begin, len(order))), values)})]))
        return pa.concat_tables(found)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [right[c].combine_chunks() for c in keys]
        total = None
        for x in unpack(left["data"], PACK):
            distinct, own, met = _codes(known, [x[c] for c in keys])
            total = np.zeros(len(distinct) * dim) if total is None else total
            size = x["size"].to_numpy()
            w = np.repeat(x["weight"].to_numpy(), size) * x["tf"].to_numpy()
            at = met * dim + np.repeat(x["place"].to_numpy(), size)
            total += np.bincount(at[met >= 0], weights=w[met >= 0], minlength=len(total))
        v = np.zeros((len(right), dim))
        if total is not None:
            v = np.where((own >= 0)[:, None], total.reshape(-1, dim)[own] if len(distinct) else 0.0, 0.0)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        ends = pa.array(np.arange(len(v) + 1) * dim, pa.int32())
        return pa.table({**dict(zip(keys, known)), out_col: pa.ListArray.from_arrays(ends, pa.array(v.ravel()))})

    def placed(batches):
        for batch in batches:
            if len(batch):
                to = (_key_hash(batch.columns) % np.uint64(n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), *batch.columns], ["to", *keys])

    kind, packs = dict(rows.dtypes), "to int, data binary"
    key_schema = ", ".join(f"`{c}` {kind[c]}" for c in keys)
    weights = fitted.select(F.pmod(F.crc32("term"), F.lit(n)).cast("int").alias("to"), "term", "place", "weight")
    met = lists.mapInArrow(by_term, packs).groupBy("to").cogroup(weights.groupBy("to")).applyInArrow(weighted, packs)
    asked = rows.select(*keys).mapInArrow(placed, f"to int, {key_schema}")
    return met.groupBy("to").cogroup(asked.groupBy("to")).applyInArrow(summed, f"{key_schema}, {out_col} array<double>")


def embed_texts(df: DataFrame, text_col: str, fitted: DataFrame, keys: list[str], dim: int = DIM) -> DataFrame:
    """Vectors of texts that are not in the index (queries), under the same weights."""
    counts = df.select(*keys, F.explode(tokens(text_col)).alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("tf"))
    return embed_terms(df, counts, fitted, keys, dim)
