"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into six blocks. Fingerprints that differ in at
most three bits agree in at least three whole blocks, so each fingerprint is
listed under all twenty choices of three blocks (30 to 33 equal bits), equal
keys meet, and the Hamming distance is verified on the whole fingerprint.

Scale: copies of one text share a fingerprint and are merged first (partial
minimum), so only distinct fingerprints are listed. Keys with one fingerprint
are dropped before anything is gathered. A key with many distinct fingerprints
(a large group of near copies) is dealt in chunks of about ``chunk``
fingerprints: every pair of chunks is compared by its own task, so no task
holds a whole group, and a comparison returns a spanning forest of its links
(at most one edge a fingerprint), never all pairs. Components of these edges
are the components of all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import map_rows, materialize, stored
from corpuskit.llm.components import components

# Bit ranges of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of lower-cased (A-Z) word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))]
    hashed = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(grams)
    for at in range(0, n, 32_768):  # bounded memory on very long texts
        part = grams[at:at + 32_768]
        h = np.fromiter((hashed(g, 42) for g in part), dtype=np.uint64, count=len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Key columns and ``fp`` (the fingerprint as a signed long) of every row."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fp long"

    def make():
        def row(*values):
            fp = fingerprint(values[-1], shingle)
            yield (*values[:-1], fp - (1 << 64) if fp >> 63 else fp)
        return row

    return map_rows(df.select(*keys, text_col), schema, make)


def forest(bits: int):
    """Arrow function: rows of (fps, sides) to the edges of a spanning forest.

    ``sides`` says which of the two compared chunks a fingerprint is of;
    with one chunk all pairs are compared, with two those across.
    """
    def run(batches):
        for batch in batches:
            left, right = [], []
            for fps, sides in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, s = np.array(fps, dtype=np.int64).view(np.uint64), np.array(sides)
                first = s == s[0]
                i, j = (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(x)),) * 2
                parent = list(range(len(x)))

                def root(a):
                    while parent[a] != a:
                        parent[a] = parent[parent[a]]
                        a = parent[a]
                    return a

                for a in i.tolist():
                    near = j[np.bitwise_count(x[j] ^ x[a]) <= bits]
                    for b in near.tolist():
                        ra, rb = root(a), root(b)
                        if ra != rb:
                            parent[max(ra, rb)] = min(ra, rb)
                            left.append(fps[a])
                            right.append(fps[b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
    return run


def links(distinct: DataFrame, bits: int = 3, chunk: int = 256) -> DataFrame:
    """Spanning edges (a, b) of all links between distinct fingerprints (column ``fp``)."""
    if not 0 <= bits <= 3:
        raise ValueError("six blocks guarantee a shared triple for up to 3 bits")
    keys = []
    for c, trio in enumerate(combinations(range(6), 3)):
        mask = sum(((1 << n) - 1) << at for at, n in (BLOCKS[k] for k in trio))
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")))
    # listed once under each choice of three blocks
    listed = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.c", "x.k")
    shared = listed.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = listed.join(shared, ["c", "k"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = met.select("fp", "c", "k", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    groups = dealt.groupBy("c", "k", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).agg(
        F.collect_list("fp").alias("fps"), F.collect_list("i").alias("sides"))
    return groups.select("fps", "sides").filter(F.size("fps") > 1).mapInArrow(
        forest(bits), "a long, b long").distinct()


def near_duplicates(df: DataFrame, keys: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, bits: int = 3) -> DataFrame:
    """Key columns, ``fp``, ``component_id`` (smallest id reachable over links)
    and ``root`` (the component's smallest fingerprint, signed) of every row.

    Defined results: null and empty texts have fingerprint 0, which links like
    any other; repeated rows come back once each; a null id never is the
    smallest one, and a component of null ids only has component_id null. Very
    long texts are hashed whole; an empty table gives an empty result. Extra
    columns are not touched.
    """
    keys = keys or [id_col]
    # read by four later steps: written once to the shared folder
    docs = stored(fingerprints(df, keys, text_col, shingle), "fingerprints")
    distinct = materialize(docs.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    found = components(links(distinct, bits), "a", "b")
    found = found.withColumnRenamed("vertex", "fp")
    smallest = distinct.join(found, "fp").groupBy("root").agg(F.min("least_id").alias("joint_id"))
    named = distinct.join(found.join(smallest, "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("joint_id")).alias("component_id"))
    named = materialize(named)  # so that the join below, where copies meet one key, can be split
    return docs.join(named, "fp").select(*keys, "fp", "component_id", "root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             bits: int = 3) -> DataFrame:
    """One document of each component, with all its columns: the smallest id
    (of rows that repeat this id in the component, the one whose text hashes
    lowest; a component of null ids keeps one of them)."""
    tagged = df.withColumn("__th", F.xxhash64(text_col))
    found = near_duplicates(tagged, [id_col, "__th"], id_col, text_col, shingle, bits)
    chosen = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("__th", id_col)).alias("x")).select("x.*")

    def keyed(rows: DataFrame) -> DataFrame:  # plain keys: the join's partitions serve the next step too
        return rows.withColumn("__none", F.col(id_col).isNull()).withColumn(
            "__id", F.coalesce(F.col(id_col), F.lit(0).cast(df.schema[id_col].dataType)))

    keys = ["__th", "__none", "__id"]
    kept = keyed(tagged).join(keyed(chosen).select(*keys), keys, "left_semi")
    # identical rows (same id, same text) are one document
    return kept.dropDuplicates(keys).select(*df.columns)
