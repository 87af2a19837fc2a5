"""Language-model scores by masked pseudo-likelihood.

A small bidirectional window network predicts every token's class from its
neighbours on both sides, and the token is then chosen within its class:
p(token | left, right) = p(class | left, right) * p(token | class). A
document's score is the sum of its tokens' conditional log-probabilities.

* Tokens are words as they stand. Each belongs to one of ``classes`` classes:
  the document edge, the most frequent words of the corpus (in any case), and
  shape classes for the rest (number, signs, upper case, mixed, and the hashed
  end of a plain word).
* p(token | class) is the token's share of its class in the whole corpus, for
  every token that occurs: Spark counts them all. The ``FREQUENT`` most
  frequent ones travel with the tasks; the others of a document are joined
  with the table of all tokens, however many there are.
* What the network learns from is gathered over the whole corpus by Spark:
  counts of (left, token, right), summed per task and then per triple. With a
  window of one token on each side these counts are all the training data, so
  full-batch training on them is training on every token.
* The network (embeddings of both neighbours, one tanh layer, softmax) is
  trained in numpy. Its input is bounded by classes**3 counts, whatever the
  size of the corpus, and so is the table of its log-probabilities with which
  the tasks score the documents.

Defined results: null and empty texts have 0 tokens, score 0.0 and a null
mean; repeated rows are scored one by one (and count each time in training);
an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import WORD, map_rows, materialize, stored

CLASSES = 128
#: Of the classes: the edge, five shapes, and hashed ends of plain words.
EDGE, SHAPES, ENDS = 0, 5, 26
SEED = 7
#: Tokens whose shares of their classes travel with the tasks; all others are joined.
FREQUENT = 200_000
#: Shares are summed as whole multiples of 1e-9, so their order does not matter.
UNIT = 1e-9


def token_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): every token of all documents and how often it occurs."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    return df.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def named_words(counts: DataFrame, classes: int = CLASSES) -> list[str]:
    """The most frequent words of counted tokens, as many as have a class of their own."""
    low = counts.groupBy(F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    return [r["w"] for r in low.orderBy(F.desc("n"), "w").limit(classes - 1 - SHAPES - ENDS).collect()]


def vocabulary(df: DataFrame, text_col: str = "text", classes: int = CLASSES) -> list[str]:
    """The most frequent words of all documents, as many as have a class of their own."""
    return named_words(token_counts(df, text_col), classes)


def kinds(words: list[str]) -> Callable[[str], int]:
    """Function from a token to its class."""
    named = {w: 1 + i for i, w in enumerate(words)}
    shapes = CLASSES - SHAPES - ENDS

    def kind(word: str) -> int:
        low = word.lower()
        if low in named:
            return named[low]
        core = low.strip(".,;:!?\"'()")
        if core.isalpha():
            if word.isupper() and len(core) > 1:
                return shapes + 2
            return shapes + SHAPES + zlib.crc32(core[-2:].encode()) % ENDS
        if not any(c.isalpha() for c in word):
            return shapes + (0 if any(c.isdigit() for c in word) else 1)
        return shapes + (3 if any(c.isdigit() for c in word) else 4)

    return kind


def classifier(words: list[str], remembered: int = 200_000) -> Callable[[str | None], np.ndarray]:
    """Function from a text to its classes, an edge on both ends."""
    kind = kinds(words)

    class Remembered(dict):
        def __missing__(self, key):
            got = kind(key.decode())
            if len(self) < remembered:
                self[key] = got
            return got

    known = Remembered().__getitem__

    def encode(text: str | None) -> np.ndarray:
        found = (text or "").encode().split()
        out = np.zeros(len(found) + 2, dtype=np.int64)
        out[1:-1] = np.fromiter(map(known, found), dtype=np.int64, count=len(found))
        return out

    return encode


def triples(df: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """(code, n): counts of (left, token, right) over all documents, with
    code = (left * classes + right) * classes + token."""
    def run(batches):
        encode = classifier(words)
        total = np.zeros(CLASSES ** 3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                x = encode(text)
                np.add.at(total, (x[:-2] * CLASSES + x[2:]) * CLASSES + x[1:-1], 1)
        code = np.flatnonzero(total)
        for at in range(0, len(code), 100_000):
            part = code[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["code", "n"])

    found = df.select(text_col).mapInArrow(run, "code long, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


class WindowNetwork:
    """p(token | left, right): embeddings, one tanh layer, softmax; Adam, full batch."""

    def __init__(self, classes: int = CLASSES, width: int = 16, hidden: int = 48, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"left": rng.normal(0, 0.3, (classes, width)), "right": rng.normal(0, 0.3, (classes, width)),
                  "wl": rng.normal(0, 0.3, (width, hidden)), "wr": rng.normal(0, 0.3, (width, hidden)),
                  "bh": np.zeros(hidden), "out": rng.normal(0, 0.1, (hidden, classes)), "bo": np.zeros(classes)}

    def forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        hidden = np.tanh(p["left"][left] @ p["wl"] + p["right"][right] @ p["wr"] + p["bh"])
        logits = hidden @ p["out"] + p["bo"]
        logits -= logits.max(axis=1, keepdims=True)
        return hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def train(self, left, right, counts, steps: int = 250, rate: float = 0.03) -> list[float]:
        """Minimise the mean negative log-probability; returns its course."""
        p, total = self.p, counts.sum()
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        p["bo"][:] = np.log((counts.sum(axis=0) + 0.1) / (total + 0.1 * counts.shape[1]))
        rows, course = counts.sum(axis=1, keepdims=True), []
        for step in range(1, steps + 1):
            hidden, logp = self.forward(left, right)
            course.append(float(-(counts * logp).sum() / total))
            d = (np.exp(logp) * rows - counts) / total
            dh = (d @ p["out"].T) * (1 - hidden ** 2)
            el, er = p["left"][left], p["right"][right]
            g = {"out": hidden.T @ d, "bo": d.sum(axis=0), "bh": dh.sum(axis=0), "wl": el.T @ dh, "wr": er.T @ dh,
                 "left": np.zeros_like(p["left"]), "right": np.zeros_like(p["right"])}
            np.add.at(g["left"], left, dh @ p["wl"].T)
            np.add.at(g["right"], right, dh @ p["wr"].T)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                p[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-9)
        return course

    def table(self) -> np.ndarray:
        """log p as a flat array over the codes of ``triples``."""
        left, right = np.divmod(np.arange(CLASSES ** 2), CLASSES)
        return self.forward(left, right)[1].astype(np.float32).ravel()


def fit(codes: np.ndarray, n: np.ndarray, **settings) -> WindowNetwork:
    """Train on triple counts."""
    context, token = np.divmod(codes, CLASSES)
    used, row = np.unique(context, return_inverse=True)
    counts = np.zeros((len(used), CLASSES))
    counts[row, token] = n
    network = WindowNetwork()
    if len(used):
        network.train(*np.divmod(used, CLASSES), counts, **settings)
    return network


def score(df: DataFrame, words: list[str], table: np.ndarray, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_likelihood) per document."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long, log_likelihood double, mean_log_likelihood double"

    def make():
        encode = classifier(words)

        def row(key, text):
            x = encode(text)
            n = len(x) - 2
            total = float(table[(x[:-2] * CLASSES + x[2:]) * CLASSES + x[1:-1]].sum(dtype=np.float64))
            yield key, n, total, total / n if n else None
        return row

    return map_rows(df.select(id_col, text_col), schema, make)


def token_shares(counts: DataFrame, words: list[str]) -> DataFrame:
    """(w, n, class, units), written: log p(token | class) of every counted token, in ``UNIT``."""
    def run(batches):
        kind = kinds(words)
        for batch in batches:
            found = pa.array([kind(w) for w in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["w", "n", "class"])

    classed = stored(counts.mapInArrow(run, "w string, n long, class int"), "classed")
    sizes = F.broadcast(classed.groupBy("class").agg(F.sum("n").alias("size")))  # at most classes rows
    units = F.round(F.log(F.col("n") / F.col("size")) / UNIT).cast("long")
    return classed.join(sizes, "class").select("w", "n", "class", units.alias("units"))


def most_frequent(shares: DataFrame, frequent: int) -> DataFrame:
    """The tokens that occur at least so often that there are ``frequent`` of them at most."""
    times = shares.groupBy("n").count().orderBy(F.desc("n")).limit(frequent).toArrow()
    held = np.cumsum(times["count"].to_numpy().astype(np.int64)) <= frequent
    least = times["n"].to_numpy()[held]
    return shares.filter(F.col("n") >= int(least[-1])) if len(least) else shares.limit(0)


def score_tokens(df: DataFrame, words: list[str], table: np.ndarray, shares: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_likelihood) per document: ``score`` of its
    classes and the ``shares`` of its tokens. One pass over the texts adds up the classes and
    the ``frequent`` tokens and lists the others, which are joined with their shares."""
    top = most_frequent(shares, frequent).toArrow()
    forms, n_top = top["w"].to_pylist(), len(top)
    classes = np.concatenate([top["class"].to_numpy().astype(np.int64), np.arange(CLASSES)])
    units = np.concatenate([top["units"].to_numpy().astype(np.int64), np.zeros(CLASSES, dtype=np.int64)])
    schema = (f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long, classes_log double, units long, others array<string>")

    def make():
        kind = kinds(words)
        at = {w.encode(): i for i, w in enumerate(forms)}.get

        def row(key, text):
            found = (text or "").encode().split()
            code = np.fromiter((at(w, -1) for w in found), dtype=np.int64, count=len(found))
            others = [found[i].decode() for i in np.flatnonzero(code < 0)]
            code[code < 0] = [n_top + kind(w) for w in others]
            x = np.concatenate([[EDGE], classes[code], [EDGE]])
            total = float(table[(x[:-2] * CLASSES + x[2:]) * CLASSES + x[1:-1]].sum(dtype=np.float64))
            yield key, len(found), total, int(units[code].sum()), others
        return row

    passed = stored(map_rows(df.select(id_col, text_col), schema, make).withColumn("_row", F.monotonically_increasing_id()), "passed")
    rare = passed.select("_row", F.explode("others").alias("w")).join(shares.select("w", F.col("units").alias("_units")), "w")
    rare = rare.groupBy("_row").agg(F.sum("_units").alias("_rare"))
    total = F.col("classes_log") + (F.col("units") + F.coalesce("_rare", F.lit(0))) * F.lit(UNIT)
    out = passed.drop("others").join(rare, "_row", "left").withColumn("log_likelihood", total)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(id_col, "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Train on all documents of ``df`` and score each of them."""
    tokens = stored(token_counts(df, text_col), "tokens")
    words = named_words(tokens)
    counts = materialize(triples(df, words, text_col)).orderBy("code").toArrow()  # at most classes**3 rows
    network = fit(counts["code"].to_numpy(), counts["n"].to_numpy())
    return score_tokens(df, words, network.table(), token_shares(tokens, words), id_col, text_col, frequent)
