"""SimHash near-duplicates, mixing, packing and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import components, mixing, packing, quality, secret_scan, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """{id: smallest id reachable} by all pairs, from (id, fingerprint)."""
    parent = {i: i for i, _ in pairs}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in pairs:
        for j, y in pairs:
            if i < j and (x ^ y).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def test_near_duplicates_match_all_pairs(docs, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts}
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: signed(fp) for i, fp in fps.items()}
    assert {i: x[1] for i, x in got.items()} == plain_components(list(fps.items()))


@pytest.mark.parametrize("chunk", [3, 256])
def test_links_of_dense_groups(spark, chunk):
    """Chains and dense balls of fingerprints, in one chunk and in many."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
            if rng.random() < 0.3:
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.links(df, 3, chunk).collect()
    assert len(edges) <= 20 * len(fps) * (1 + len(fps) // chunk)
    got = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = plain_components([(signed(x), x) for x in fps])
    assert {x: got.get(x, x) for x in want} == want


def test_components_long_chain_and_empty(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    chain = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(7, 7), (None, 3)], "a long, b long")
    assert {r["root"] for r in components.components(chain, "a", "b").collect()} == {0}
    assert components.components(chain.limit(0), "a", "b").count() == 0


def test_near_duplicates_awkward(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and simhash.keep_one(nothing).count() == 0
    # fingerprint 0 once, the repeated row once, ids 5, null, and id 6 with both its texts
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, 5: 1, None: 1, 6: 2}


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, capped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:  # the excess goes to the others by weight until none is above
        free = [s for s in names if s not in capped]
        rest = left - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] for s in capped} | {s: rest * weight[s] / total for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def check_mix(rows):
    """rows of (doc_id, size, source_size, target, taken, source)."""
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    return want, taken


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    want, taken = check_mix(rows)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs, bins=1).collect()))


def test_mixing_by_pareto_order(spark):
    """In a source, the documents taken once more than others are those of the least rank."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    u = {r["doc_id"]: r["u"] for r in df.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")).collect()}
    by = defaultdict(list)
    for r in mixing.mix(df).collect():
        copies = int(r["target"] // r["source_size"])
        by[r["source_size"]].append((u[r["doc_id"]], r["taken"] - copies * r["size"], r["size"]))
    for rows in by.values():
        rows.sort()
        part = [k for k, (_, more, size) in enumerate(rows) if more != size]
        first = part[0] if part else len(rows)
        assert all(more == 0 for _, more, _ in rows[first + 1:])


def test_mixing_awkward(awkward, nothing, spark):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and mixing.mix(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
    out = mixing.mixture(awkward)
    assert out.columns == awkward.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    assert +got == +want
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in mixing.mix(blank).collect()] == [(0, 0, 0.0, 0)] * 2


def test_ties_share_the_boundary(spark):
    df = spark.createDataFrame([(9, "a b c d", "s")] * 6 + [(10, "a b", "t")], "doc_id long, text string, source string")
    want, taken = check_mix([r.asDict() | {"source": "s" if r["doc_id"] == 9 else "t"} for r in mixing.mix(df).collect()])
    assert want["s"] - 6 <= taken["s"] <= want["s"] + 0.5


def check_packing(rows, ids, size=4096):
    """Every id in exactly one piece, sequences gapless, checksums right."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc, total), own in pieces.items():
        candidates = [x for x in ids[doc] if len(x) == total]
        for k, r in enumerate(sorted(own, key=lambda r: (r["start"], r["ids_crc32"]))):
            assert r["ids_crc32"] in {zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for x in candidates}
        assert sum(r["length"] for r in own) == total * len(candidates)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(sequences)


def plain_ids(pairs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for doc, text in pairs:
        out[doc].append([*tok.encode(text or "", add_special_tokens=False).ids, 2])
    return out


@pytest.mark.parametrize("size, buckets", [(4096, 256), (100, 3)])
def test_packing_round_trip(docs, texts, size, buckets):
    ids = plain_ids(texts)
    rows = packing.pack_documents(docs, size=size, buckets=buckets).collect()
    n = check_packing(rows, ids, size)
    total = sum(len(x) for own in ids.values() for x in own)
    assert total <= n * size <= total * 1.1 + size


def test_packing_awkward(awkward, nothing):
    pairs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    rows = packing.pack_documents(awkward).collect()
    check_packing(rows, plain_ids(pairs))
    assert packing.pack_documents(nothing).count() == 0


def test_token_ids_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.token_ids()
    rng = random.Random(3)
    alphabet = "aAzZ09'<>|&;:.,-_~éÉßµªº×÷ÿÞ \t\n\x0b\x1c\x85\xa0​́İσΣ漢😀ﬁ½²"
    odd = ["it's don't 'S we'LL x<|endoftext|>y <|startoftext|>", "", " \n"]
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in odd:
        assert ids(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_patterns_place_every_length_shortest_pack_first():
    rng = random.Random(2)
    histogram = {rng.randint(1, 99): rng.randint(1, 500) for _ in range(60)}
    packs = packing.patterns(dict(histogram), 100)
    placed = Counter()
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 100 and lengths == sorted(lengths, reverse=True)
        for x in lengths:
            placed[x] += count
    assert placed == histogram
    assert packing.patterns({60: 2, 40: 3, 10: 1}, 100) == [(2, [60, 40]), (1, [40, 10])]
    assert packing.patterns({}, 100) == []


@pytest.mark.parametrize("histogram, size, most", [
    ({300: 100_000}, 4096, 7693), ({2: 7, 1: 10**6}, 4096, 245), ({40: 2, 30: 4}, 100, 2),
    ({120: 50_000, **{x: 20 for x in range(1, 4096)}}, 4096, None)])
def test_patterns_of_a_hot_length(histogram, size, most):
    packs = packing.patterns(dict(histogram), size)
    placed = Counter()
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= size
        for x in lengths:
            placed[x] += count
    assert placed == histogram
    n, least = sum(count for count, _ in packs), -(-sum(x * k for x, k in histogram.items()) // size)
    assert n <= (most or least * 1.01)
    # ranks of a length are dealt once each, and no two pieces overlap
    ends = defaultdict(int)
    table = packing.places(packs)
    assert {x: int((table[:, 0] == x).sum()) > 0 for x in histogram} == dict.fromkeys(histogram, True)
    for x in sorted(histogram)[:3]:
        own = table[table[:, 0] == x]
        bounds = [*own[:, 1].tolist(), histogram[x]]
        for (_, first, sequence, at), after in zip(own.tolist(), bounds[1:]):
            assert after > first
            for k in range(min(after - first, 50)):
                assert at >= 0 and (sequence + k, at) not in ends
                ends[sequence + k, at] = x


def test_packing_of_copies(spark):
    """Copies of one text share sequences."""
    pairs = [(i, "one two three four five six seven") for i in range(200)] + [(500, "a b c " * 20)]
    rows = packing.pack_documents(spark.createDataFrame(pairs, "doc_id long, text string"), size=100, buckets=3).collect()
    ids = plain_ids(pairs)
    total = sum(len(x) for own in ids.values() for x in own)
    assert check_packing(rows, ids, 100) * 100 <= total * 1.1 + 100


def test_pipeline_against_plain_version(spark, tmp_path):
    """The stages by plain Python over the small table."""
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    step = []
    for r in rows:
        got = quality.judge(r["text"])
        if got[6]:
            step.append(r | {"text": got[-1], "n_chars": len(got[-1])})
    frames, out = [], docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out, d).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(out)
        if k < 4:
            assert out.columns == docs.columns
    as_set = lambda rows: Counter(tuple(r[c] for c in docs.columns) for r in rows)
    assert as_set(frames[0].collect()) == as_set(step)
    named = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in step])
    step = [r for r in step if named[r["doc_id"]] == r["doc_id"]]
    assert as_set(frames[1].collect()) == as_set(step)
    encode = secret_scan.encoder()
    for r in step:
        r["text"] = secret_scan.redact_text(r["text"], secret_scan.scan_text(r["text"], encode)[1])
        r["n_chars"] = len(r["text"])
        assert not secret_scan.base_spans(r["text"])
    assert as_set(frames[2].collect()) == as_set(step)
    whole = {r["doc_id"]: r for r in step}
    words, sizes = Counter(), Counter()
    for r in step:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in frames[3].collect():
        assert whole[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        words[r["source"]] += len(WORD.findall(r["text"]))
    for s, t in plain_targets(dict(sizes)).items():
        assert abs(words[s] - t) <= 0.5 + 1e-6
    check_packing(frames[4].collect(), plain_ids([(r["doc_id"], r["text"]) for r in frames[3].collect()]))
    assert pipeline.run(spark, d).count() == frames[4].count()
