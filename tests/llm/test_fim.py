"""Fill-in-the-middle: a plain version, random bytes of text, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpuskit.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """A row of the result as the contract states it."""
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    return [(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in df.collect()]


def test_equals_the_plain_version_and_restores(spark, docs, texts):
    made = fim.transform(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in made.collect()}
    assert got == {i: plain(i, t) for i, t in texts}
    assert {g[1] for g in got.values()} == {"plain", "psm", "spm"}
    back = {r["doc_id"]: r["restored"] for r in fim.restore(made).collect()}
    assert back == {i: t or "" for i, t in texts}


def test_random_texts_in_small_runs():
    """The numpy core on texts of spaces, marks, parts of marks and long characters."""
    rng = random.Random(5)
    parts = [" ", "\n", "\t", "\x0b", "\x1c", "a", "ß", "漢", "😀", "<", ">", "<P", "S>", "<M", " ", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)] + ["<P>", "x<S>y", "<M> ", "", " "]
    h = np.array([[rng.getrandbits(32) for _ in range(2)] + [0, rng.getrandbits(32)] for _ in texts], dtype=np.int64)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    seen = 0
    for first, last in fim._runs(offsets, 1000):
        flat, start = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        cuts = fim.cut_run(flat, start, h[first:last])
        out, new = fim.scatter(flat, start, cuts["cut1"], cuts["cut2"], cuts["form"])
        back, old = fim.gather(out, new, cuts["form"])
        assert back.tobytes() == flat.tobytes() and (old == start).all()
        for i in range(last - first):
            t, form = texts[first + i], fim.FORMS[cuts["form"][i]]
            units = TOKEN.findall(t)
            a, b = sorted(int(x) % (len(units) + 1) for x in h[first + i][:2])
            p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            assert out[new[i]:new[i + 1]].tobytes().decode() == want and cuts["n"][i] == len(units)
            assert (form == "plain") == (not t or any(x in t for x in ("<P>", "<S>", "<M>")))
            seen += 1
    assert seen == len(texts)


def test_awkward_rows_and_an_empty_table(awkward, nothing):
    made = fim.transform(awkward)
    want = sorted(map(str, (plain(r["doc_id"], r["text"]) for r in awkward.collect())))
    assert sorted(map(str, rows_of(made))) == want
    back = fim.restore(made)
    assert sorted(r["restored"] for r in back.collect()) == sorted(r["text"] or "" for r in awkward.collect())
    assert fim.digests(awkward).count() == awkward.count()
    assert fim.transform(nothing).count() == 0 and fim.digests(nothing).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_a_text_longer_than_a_run(spark):
    text = "word ünd " * 1_200_000
    df = spark.createDataFrame([(i, text + str(i)) for i in range(4)], "doc_id long, text string")
    made = fim.restore(fim.transform(df, fim_percent=100)).collect()
    assert [r["restored"] for r in made] == [r["text"] for r in df.collect()]
    assert {r["form"] for r in made} - {"plain"}


def test_outputs_without_their_marks_are_refused():
    with pytest.raises(ValueError):
        fim.gather(np.frombuffer(b"<P>a<S>b", dtype=np.uint8), np.array([0, 8]), np.array([1]))
