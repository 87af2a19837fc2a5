"""Exact set-similarity join (#74): prefix filter, length filter, verification.

Two sets with a Jaccard similarity of at least ``s`` share a token among their
first ``n - ceil(s * n) + 1`` tokens, whatever order the tokens are put in, and ``m``
tokens (or all that they must share, if fewer) among ``m - 1`` more; with the
rarest tokens first, such prefixes meet few others, and seldom in several tokens. So

1. sets with the same tokens become one (its smallest key stands for it);
2. tokens are counted once; the ``FREQUENT`` most frequent ones are known by
   rank, all others count as rarer and are ordered by their hash (the order
   decides how many candidates there are, never which pairs are found);
3. the prefixes are joined on their tokens, by blocks of sets of about one size: a task has
   whole prefixes, so it counts what two sets share. A pair is a candidate only if the
   sizes and the places of the shared tokens leave room for the similarity, and
   there are ``SHARED`` of them (for sets of like sizes, up to ``MORE`` more);
4. candidates meet on sketches first (tokens counted by class, ``CLASSES`` bytes a
   set, which bound what two sets share); those left are verified on the whole sets.

Links between copies of one text would grow with the square of their number, so
the join runs twice. First every set meets only the smallest key under each of
its tokens, which links nearly all of a group of copies; of the second, full
join those pairs are left out that are in one component already; the rows of the most
common component of a token are set apart, so they do not meet each other. Components (and with them every class) are those of all pairs.

Tokens are compared by their 64-bit hashes. Keys are unique; null keys and texts
and sets without tokens take no part. A size that very many sets have is dealt into
several blocks, so no task joins a token with itself alone.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import tokens
from corpuskit.operators.components import components
from corpuskit.operators.packed import pack, spread, text_hash, unpack
from corpuskit.operators.retrieval import small
from corpuskit.session import checkpoint_dir, shuffles_dropped

FREQUENT = 500_000  # tokens known by rank (16 bytes each)
BLOCKS = 16        # blocks of sets by size, unless that makes them
LEAST_BLOCK = 2048  # smaller than this, or
MOST_BLOCK = 65_536  # larger (sets)
SLICE = 2048       # sets of a batch that a worker packs or sketches at a time
X_SETS = 2048      # sets whose prefixes are looked up at a time
STEP = 400_000     # pairs of equal tokens that a task holds at a time, about
OFTEN = 16         # rows of a token with one root, from which on they are set apart
CLASSES = 512      # classes by which tokens are counted before sets are compared
SKETCHED = 16_384  # sketches of a bucket, on average
SHARED = 3         # tokens of their prefixes that the sets of a candidate pair share,
MORE = 6           # and up to so many more where the prefixes are long enough for their sizes
VERIFY = 4096      # sets of a bucket of the verification, on average
DICTIONARY = 8 << 20  # bytes of a written file's dictionary: token hashes repeat, but are many


def prefix_length(n: int, least: float, shared: int = 1) -> int:
    """Tokens among which two similar sets must share ``shared`` (or all that they must share, if fewer)."""
    return min(n, n - math.ceil(round(least * n, 9)) + shared)


def _sets(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, tokens): different token hashes of each text, in the order of the hashes."""
    hashed = F.sort_array(F.transform(tokens(text_col, distinct=True), lambda t: F.xxhash64(t)))
    return df.filter(F.col(key).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(key).alias("key"), hashed.alias("tokens")).filter(F.size("tokens") > 0)


def _written(df: DataFrame) -> DataFrame:
    """The table in a new folder under the shared one (columnar: these rows repeat their values)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/set-join-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("parquet.dictionary.page.size", DICTIONARY).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _frequent(sets: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in the order of their hashes, their ranks) of the most frequent tokens that
    two sets have, the rarest ranked first: a bounded table of at most ``most`` rows."""
    counted = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counted.orderBy(F.desc("n"), "t").limit(most).toArrow()
    known, n = top["t"].to_numpy(), top["n"].to_numpy()
    rank = np.empty(len(known), dtype=np.int32)
    rank[np.lexsort((known, n))] = np.arange(1, len(known) + 1)
    order = np.argsort(known)
    return known[order], rank[order]


def _ordered(rank: tuple[np.ndarray, np.ndarray], least: float):
    """Function: the prefix of a set, rarest tokens first (rank 0: beyond the known ones)."""
    known, ranks = rank

    def prefix(t: np.ndarray) -> np.ndarray:
        order = np.zeros(len(t), dtype=np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, t), len(known) - 1)
            hit = known[place] == t
            order[hit] = ranks[place[hit]]
        return t[np.lexsort((t, order))[:prefix_length(len(t), least, SHARED)]]

    return prefix


def prefix_sets(sets: DataFrame, least: float, rank: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, size, tokens): the prefix of every set, rarest tokens first, and the size of the whole set. A token is
    folded into 32 bits: two that are folded alike make a candidate more, never one less."""
    prefix = _ordered(rank, least)

    def run(batches):
        for batch in batches:
            at, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            made = [prefix(flat[i:j]) for i, j in zip(at, at[1:])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in made], dtype=np.int64)])
            found = np.concatenate([*made, np.zeros(0, np.int64)])
            folded = pa.array((found ^ (found >> 32)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int32)),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), folded)], ["key", "size", "tokens"])

    return sets.select("key", "tokens").mapInArrow(run, f"key {dict(sets.dtypes)['key']}, size int, tokens array<int>")


def prefixes(sets: DataFrame, least: float, rank: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, pos, key, size): the prefix of every set as rows that hold nothing more."""
    return prefix_sets(sets, least, rank).select("key", "size", F.posexplode("tokens").alias("pos", "token")).select(
        "token", "pos", "key", "size")


def _needed(total, least: float):
    """Tokens that two sets of ``total`` tokens together must share (numpy)."""
    return np.ceil(np.round(least / (1 + least) * total, 6))


def _slices(batches):
    """The batches in slices of ``SLICE`` sets: what a worker makes of one at a time stays small."""
    for batch in batches:
        yield from (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE))
        pa.default_memory_pool().release_unused()


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """(tokens a set, the tokens) of a batch of (key, size, tokens, ...)."""
    return pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64), pc.list_flatten(batch.column(2))


def _key_order(keys: pa.Array) -> np.ndarray:
    """Numbers in the order of the keys."""
    if pa.types.is_integer(keys.type):
        return keys.to_numpy().astype(np.int64)
    return np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)


def _with_least(prefix: DataFrame, least: float) -> DataFrame:
    """(a, b): every set with the smallest key under each of its prefix tokens, if sizes and places leave room for the
    similarity. The tokens cross the network in packs, once."""
    n = int(prefix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(prefix.dtypes)["key"]

    def dealt(batches):
        for batch in _slices(batches):
            size, flat = _flat(batch)
            take = pa.array(np.repeat(np.arange(len(batch)), size))
            own = {"token": flat, "pos": pa.array(spread(np.zeros(len(batch), np.int64), size), pa.int32()),
                   "key": batch.column(0).take(take), "size": batch.column(1).take(take)}
            yield pack(flat.to_numpy().astype(np.int64) % n, own, {})

    def met(table: pa.Table) -> pa.Table:
        x = next(unpack(table["data"]))
        token, pos, size = (x[c].to_numpy().astype(np.int64) for c in ("token", "pos", "size"))
        key = _key_order(x["key"])
        order = np.lexsort((key, token))
        token, pos, size, key = token[order], pos[order], size[order], key[order]
        begin = np.flatnonzero(np.diff(token, prepend=token[0] - 1))
        first = np.repeat(begin, np.diff(np.append(begin, len(token))))
        rest = np.minimum(size - pos, (size - pos)[first])
        short, long = np.minimum(size, size[first]), np.maximum(size, size[first])
        room = (key != key[first]) & (short >= np.round(least * long, 6)) & (rest >= _needed(short + long, least) - (SHARED - 1))
        at = np.flatnonzero(room)
        pair = np.unique(np.stack([order[first[at]], order[at]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        return pa.table({c: x["key"].take(pa.array(i)) for c, i in zip(("a", "b"), pair)})

    packs = prefix.mapInArrow(dealt, "to int, data binary")
    return packs.groupBy("to").applyInArrow(met, f"a {kind}, b {kind}").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def size_blocks(counts: list[tuple[int, int]], most: int, least: float) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(largest size of each bin, first block of each bin and their number, blocks that the sets of a block meet as the larger ones).

    ``counts``: (size, sets) in order. A bin is a range of sizes with about ``most`` sets; one size that more sets have
    is a bin of several blocks.
    """
    top, low, held = [], [], []
    for size, n in counts:
        if not top or held[-1] + n > most:
            top, low, held = [*top, size], [*low, size], [*held, n]
        else:
            top[-1], held[-1] = size, held[-1] + n
    first = np.concatenate([[0], np.cumsum([-(-n // most) for n in held])]).astype(np.int64)
    meets = []
    for i in range(len(top)):
        bins = [j for j in range(i + 1) if top[j] >= round(least * low[i], 6)]
        meets += [[b for j in bins for b in range(first[j], first[j + 1])]] * int(first[i + 1] - first[i])
    return np.array(top), first, meets


def _in_blocks(prefix: DataFrame, least: float, most: int | None) -> DataFrame:
    """(a, b): candidate pairs of sets of different components (key, size, tokens, root).

    Sets are dealt into blocks by size; a task has the prefixes of two blocks, so it counts all that a pair shares
    in its prefixes, and only candidates leave it. The number of blocks hardly grows until they are full.
    """
    kind = dict(prefix.dtypes)["key"]
    counts = [tuple(r) for r in prefix.groupBy("size").agg(F.count(F.lit(1))).orderBy("size").collect()]
    n = sum(c for _, c in counts)
    top, first, meets = size_blocks(counts, most or min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS))), least)
    task = np.cumsum([0, *map(len, meets)])
    as_large = [np.arange(task[i], task[i + 1]) for i in range(len(meets))]
    as_small: list[list[int]] = [[] for _ in meets]
    for i, others in enumerate(meets):
        for k, j in enumerate(others):
            as_small[j].append(int(task[i]) + k)

    def dealt(batches):
        for batch in _slices(batches):
            size, (length, flat) = batch.column(1).to_numpy().astype(np.int64), _flat(batch)
            at = np.searchsorted(top, size)
            block = first[at] + _spread_hash(batch.column(0)) % (first[at + 1] - first[at])
            start = np.cumsum(length) - length
            # what the smaller of two sets is met by: the larger one is no smaller
            short = np.minimum(length, size - _needed(2 * size, least).astype(np.int64) + SHARED + MORE)
            for side, tasks, own in ((0, as_large, length), (1, as_small, short)):
                many = np.array([len(tasks[b]) for b in block])
                take = np.repeat(np.arange(len(batch)), many)
                to = np.concatenate([np.asarray(tasks[b], dtype=np.int64) for b in block])
                columns = {c: batch.column(k).take(pa.array(take)) for c, k in (("key", 0), ("size", 1), ("root", 3))}
                values = {"token": flat.take(pa.array(spread(start[take], own[take])))}
                yield pack(2 * to + side, columns, {"length": (own[take], values)})

    def met(table: pa.Table) -> pa.Table:
        side = table["to"].to_numpy() % 2
        x, y = (next(unpack(table["data"].filter(pa.array(side == k))), None) for k in (0, 1))
        if x is None or y is None:
            return pa.table({c: pa.array([], table_type) for c in ("a", "b")})
        i, j = candidates(x, y, least)
        pa.default_memory_pool().release_unused()
        return pa.table({"a": x["key"].take(pa.array(i)), "b": y["key"].take(pa.array(j))})

    table_type = pa_type(kind)
    packs = prefix.select("key", "size", "tokens", "root").mapInArrow(dealt, "to int, data binary")
    return packs.groupBy(F.floor(F.col("to") / 2)).applyInArrow(met, f"a {kind}, b {kind}").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _spread_hash(keys: pa.Array) -> np.ndarray:
    if pa.types.is_integer(keys.type):
        return ((keys.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
    return text_hash(keys.cast(pa.string()))


def candidates(x: dict[str, pa.Array], y: dict[str, pa.Array], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets of ``x`` and of smaller ones of ``y`` (or as large, with a smaller key) of another root, that
    share enough of their prefixes (key, size, root, length, token).

    Two similar sets that must share ``need`` tokens share ``m`` of them (or all) among their first ``size - need + m``.
    ``m`` is as large as the prefixes allow, ``SHARED + MORE`` at most.
    """
    n_x, n_y = len(x["key"]), len(y["key"])
    key, root = (pa.concat_arrays([x[c], y[c]]) for c in ("key", "root"))
    key, root = _key_order(key), root.dictionary_encode().indices.to_numpy().astype(np.int64)
    size = np.concatenate([x["size"].to_numpy(), y["size"].to_numpy()]).astype(np.int64)
    sx, sy, kx, ky, rx, ry = size[:n_x], size[n_x:], key[:n_x], key[n_x:], root[:n_x], root[n_x:]
    need_of = _needed(np.arange(2 * size.max() + 1), least).astype(np.int64)
    must = np.ceil(np.round(least * sx, 9)).astype(np.int64)

    # the tokens of y in the order of token, of whether the row has the most common root of its token, and of size
    length = y["length"].to_numpy().astype(np.int64)
    row, pos = np.repeat(np.arange(n_y, dtype=np.int32), length), spread(np.zeros(n_y, np.int64), length).astype(np.int32)
    words, group = np.unique(y["token"].to_numpy(), return_inverse=True)
    common = np.full(len(words), -1)
    often = np.flatnonzero(np.bincount(ry)[ry][row] >= OFTEN)
    if len(often):
        of, n = np.unique(group[often] * (root.max() + 1) + ry[row[often]], return_counts=True)
        of, n = of[n >= OFTEN], n[n >= OFTEN]
        of = of[np.argsort(n, kind="stable")]  # the last one stays: the most common
        common[of // (root.max() + 1)] = of % (root.max() + 1)
    width = int(size.max()) + 2
    code = (2 * group + (common[group] == ry[row])) * width + sy[row]
    order = np.argsort(code)
    code, row = code[order], row[order]
    size_of, place_of = sy[row].astype(np.int32), (pos[order] - sy[row]).astype(np.int32)

    length = x["length"].to_numpy().astype(np.int64)
    start, flat = np.cumsum(length) - length, x["token"].to_numpy()
    low = np.ceil(np.round(least * sx, 6)).astype(np.int64)
    need_of, sx32, must32 = need_of.astype(np.int32), sx.astype(np.int32), must.astype(np.int32)
    found_x, found_y = [], []

    def step(own: np.ndarray, begin: np.ndarray, many: np.ndarray) -> None:
        """Rows of x: set, first row of y that they meet, and how many."""
        of = spread(begin, many)
        last = need_of[np.repeat(sx32[own], many) + size_of[of]] - np.int32(MORE)
        np.maximum(last, np.repeat(must32[own], many), out=last)
        held = np.flatnonzero(place_of[of] + last < SHARED)
        pair, n = np.unique(np.repeat(own, many)[held] * n_y + row[of[held]], return_counts=True)
        one, two = np.divmod(pair, n_y)
        need = need_of[sx[one] + sy[two]]
        held = (n >= np.minimum(need, SHARED + np.clip(need - must[one], 0, MORE))) & (rx[one] != ry[two])
        held &= (sy[two] < sx[one]) | ((sy[two] == sx[one]) & (ky[two] < kx[one]))
        found_x.append(one[held])
        found_y.append(two[held])

    for i in range(0, n_x if len(words) else 0, X_SETS):
        own = np.repeat(np.arange(i, min(n_x, i + X_SETS)), length[i:i + X_SETS])
        if not len(own):
            continue
        at = np.arange(len(own)) + start[i] - start[own]
        word = flat[start[i]:start[i] + len(own)]
        order = np.argsort(word)  # looked up in their order, which is faster
        own, at, word = own[order], at[order], word[order]
        place = np.minimum(np.searchsorted(words, word), len(words) - 1)
        known = words[place] == word
        own, at, place = own[known], at[known], place[known]
        # up to this size the place is among those of which SHARED and up to MORE are shared
        high = np.floor((sx[own] - at + SHARED + MORE - 1) * (1 + least) / least - sx[own] + 1e-3).astype(np.int64)
        high = np.clip(high, 0, sx[own])
        met = []
        for side, rows in ((0, slice(None)), (1, common[place] != rx[own])):
            o, to = own[rows], (2 * place[rows] + side) * width
            begin = np.searchsorted(code, to + low[o])
            met.append((o, begin, np.searchsorted(code, to + high[rows], side="right") - begin))
        own, begin, many = (np.concatenate(c) for c in zip(*met))
        keep = np.flatnonzero(many > 0)
        keep = keep[np.argsort((own[keep] - i).astype(np.uint16), kind="stable")]  # all rows of a set in one step
        own, begin, many = own[keep], begin[keep], many[keep]
        done, total, ends = 0, np.cumsum(many), np.flatnonzero(np.diff(own, append=-1)) + 1
        while done < len(own):
            k = np.searchsorted(total[ends - 1], (total[done - 1] if done else 0) + STEP, side="right")
            end = int(max(ends[k - 1] if k else 0, ends[np.searchsorted(ends, done, side="right")]))
            step(own[done:end], begin[done:end], many[done:end])
            done = end
    return tuple(np.concatenate([*f, np.zeros(0, np.int64)]) for f in (found_x, found_y))


def class_counts(at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Tokens of each set by class, one byte a class (255: as many or more)."""
    n, size = len(at) - 1, np.diff(at)
    own = ((flat[at[0]:at[-1]].view(np.uint64) >> np.uint64(20)) % np.uint64(CLASSES)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), size) * CLASSES + own, minlength=n * CLASSES)
    return np.minimum(counts, 255).astype(np.uint8).reshape(n, CLASSES)


def may_be_similar(counts: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Of the pairs (x, y): the class counts allow the similarity (a class too full to be known allows it)."""
    out = np.zeros(len(x), dtype=bool)
    for at in range(0, len(x), 20_000):
        i, j = x[at:at + 20_000], y[at:at + 20_000]
        both = np.minimum(counts[i], counts[j])
        out[at:at + 20_000] = (both.sum(axis=1, dtype=np.int64) >= _needed(size[i] + size[j], least)) | (both.max(axis=1) == 255)
    return out


def similar(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Similarity of the pairs (x, y) of sets (sorted hashes), -1 below ``least``."""
    size = np.array([len(t) for t in sets], dtype=np.int64)
    out = np.full(len(x), -1.0)
    for p, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        found = shared / (size[i] + size[j] - shared)
        if found >= least - 1e-9:
            out[p] = found
    return out


def _sketches(sets: DataFrame) -> DataFrame:
    """(key, size, counts) of sets (key, tokens)."""
    def run(batches):
        for batch in _slices(batches):
            at, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            if len(batch):
                counts = class_counts(at, flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int32)),
                                                  pa.array([c.tobytes() for c in counts], pa.binary())], ["key", "size", "counts"])

    return sets.select("key", "tokens").mapInArrow(run, f"key {dict(sets.dtypes)['key']}, size int, counts binary")


def _compared(pairs: DataFrame, sets: DataFrame, made, most: int, check, schema: str) -> DataFrame:
    """``check`` of the written candidate pairs, and of the rows that ``made`` has of their sets.

    Keys are dealt into buckets of about ``most``; a task takes the pairs of two
    buckets and the row of each set that stands in one of them once.
    """
    asked = _written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    buckets = F.lit(max(1, -(-asked.count() // most)))
    own = made(sets.join(small(asked), "key", "left_semi"))

    def bucket(c: str) -> Column:
        return F.pmod(F.xxhash64(c), buckets).cast("int")

    dealt = pairs.withColumn("one", F.least(bucket("a"), bucket("b"))).withColumn("two", F.greatest(bucket("a"), bucket("b")))
    placed = dealt.select("one", "two", F.explode(F.array("a", "b")).alias("key")).distinct().join(own, "key")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left["key"].combine_chunks()
        x, y = (pc.index_in(right[c].combine_chunks(), value_set=keys).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("a", "b"))
        return check(left, right, x, y)

    again = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # both sides of a cogroup: own columns
    return _written(placed.groupBy("one", "two").cogroup(again.groupBy("one", "two")).applyInArrow(run, schema))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs that reach the similarity.

    Most candidates end at the sketches, so few whole sets cross the network.
    """
    kind = dict(pairs.dtypes)["a"]
    schema = pa.schema([("a", pa_type(kind)), ("b", pa_type(kind)), ("similarity", pa.float64())])

    def sketched(left: pa.Table, right: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        counts = np.frombuffer(b"".join(left["counts"].to_pylist()), dtype=np.uint8).reshape(-1, CLASSES)
        size = left["size"].to_numpy().astype(np.int64)
        return right.select(["a", "b"]).filter(pa.array(may_be_similar(counts, size, x, y, least)))

    def whole(left: pa.Table, right: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        tokens_ = left["tokens"].combine_chunks()
        at, flat = tokens_.offsets.to_numpy(), tokens_.values.to_numpy()
        found = similar([flat[i:j] for i, j in zip(at, at[1:])], x, y, least)
        take = pa.array(np.flatnonzero(found >= 0))
        return pa.Table.from_arrays([right["a"].combine_chunks().take(take), right["b"].combine_chunks().take(take),
                                     pa.array(found[found >= 0])], schema=schema)

    left = _compared(_written(pairs), sets, _sketches, SKETCHED, sketched, f"a {kind}, b {kind}")
    return _compared(left, sets, lambda own: own, VERIFY, whole, f"a {kind}, b {kind}, similarity double")


def pa_type(kind: str) -> pa.DataType:
    """Arrow type of a key column."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def links(df: DataFrame, key: str, text_col: str, max_distance: float = 0.3, frequent: int = FREQUENT,
          block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, found, classes).

    ``members``: (key, rep) of every text with tokens, ``rep`` the smallest key
    with the same tokens. ``found``: verified links (a, b, similarity) between
    representatives; they connect all that all links connect. ``classes``:
    (vertex, root) of the representatives with a link.
    """
    least = 1.0 - max_distance
    every = _written(_sets(df, key, text_col))
    named = every.select("key", F.xxhash64("tokens").alias("n1"), F.xxhash64(F.lit(1), "tokens").alias("n2"))
    reps = named.groupBy("n1", "n2").agg(F.min("key").alias("rep"))
    members = _written(named.join(reps, ["n1", "n2"]).select("key", "rep"))
    copies = small(_written(members.filter("key <> rep").select("key")))
    sets = every.join(copies, "key", "left_anti")

    prefix = _written(prefix_sets(sets, least, _frequent(sets, frequent)))

    # every set with the smallest key under each of its tokens
    first = _verified(_with_least(prefix, least), sets, least)
    part = components(first, "a", "b")

    # all others, but pairs of one component
    rooted = prefix.join(small(_written(part)), F.col("key") == F.col("vertex"), "left").withColumn(
        "root", F.coalesce("root", "key")).drop("vertex")
    found = first.unionByName(_verified(_in_blocks(rooted, least, block), sets, least))
    return members, found, components(found, "a", "b")


def near_duplicate_classes(df: DataFrame, key: str, text_col: str, max_distance: float = 0.3, frequent: int = FREQUENT,
                           block: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(key, rep_<key>, class_size): every text that is in a class of two or more.

    A class is a component of the links between texts whose token sets are at
    most ``max_distance`` apart; its smallest key names it. ``within``: a table
    of the keys that are counted and returned (all by default).
    """
    members, _, classes = links(df, key, text_col, max_distance, frequent, block)
    if within is not None:
        members = members.join(within.select(F.col(key).alias("key")), "key", "left_semi")
    rooted = members.join(classes, F.col("rep") == F.col("vertex"), "left").select(
        "key", F.coalesce("root", "rep").alias("root"))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    return rooted.join(sizes, "root").select(F.col("key").alias(key), F.col("root").alias(f"rep_{key}"), "class_size")
