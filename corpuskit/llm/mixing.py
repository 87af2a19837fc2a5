"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected copies are its
source's target over its source's size; their whole part is certain, the
rest ``pi`` is an inclusion probability. Documents are ranked by their random
odds over their inclusion odds, ``u/(1-u) / (pi/(1-pi))`` with ``u`` a hash of
the id, and taken in this order up to the words that are left of the target:
a sample of fixed size (in words). The document on the boundary is taken in
part, so every source meets its target to the word.

Scale: a source may hold most rows, so no window runs over a source. Ranks are
cut into ``bins`` bins by ``u``; partial sums per (source, bin) find the bin on
the boundary, and only that bin's rows are ordered. A document's decision then
needs its own row and its source's boundary alone.

Defined results: null text has size 0 and takes 0; sources without words have
target 0; null is a source of its own, last in order; rows that repeat an id
tie and share the boundary's words in proportion to their sizes, rounded down;
an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import materialize, n_words, stored

# Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def uniform(key: Column, seed: str = "mix") -> Column:
    """Hash of an id to (0, 1): 52 bits of an MD5, the same on every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Water filling: sources in order of cap over weight; those below the common
    level get their cap, the others their weight times the level.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    nth = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("left", F.sum("source_size").over(every) * float(share)
                     - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source whose cap reaches the level of those from it on
    t = t.withColumn("line", F.min(F.when(F.col("most") >= F.col("level") * F.col("w"), F.struct(
        F.col("most") / F.col("w"), F.col("level").alias("level")))).over(every)["level"])
    return t.select("source", "source_size", F.when(F.col("line").isNull(), F.col("most")).otherwise(
        F.least("most", F.col("line") * F.col("w"))).alias("target"))


def _rank() -> Column:
    """Random odds over inclusion odds (null where nothing is sampled)."""
    return F.try_divide(F.col("u") / (1 - F.col("u")), F.col("pi") / (1 - F.col("pi")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def boundaries(docs: DataFrame, goal: DataFrame, bins: int) -> DataFrame:
    """Per source: certain copies, and where its sample ends.

    ``docs`` has (source, size, u); ``goal`` is ``targets``. Ranks above
    ``edge`` are not taken, below it whole; at ``edge``, ``rest`` of the
    ``tied`` words are.
    """
    g = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    g = g.withColumn("pi", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("copies")).otherwise(0.0))
    g = g.withColumn("sample", F.greatest(F.lit(0), F.floor(F.col("target") + 0.5).cast("long")
                                          - F.col("copies") * F.col("source_size")))
    g = g.select(F.col("source").alias("src"), "source_size", "target", "copies", "pi", "sample")
    # the rank is a rising function of u within a source, so bins of u are bins of ranks
    binned = docs.withColumn("bin", F.floor(F.col("u") * bins).cast("int"))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("upto", F.sum("words").over(run))
    at = sums.join(g, _same("source", "src")).filter(
        (F.col("sample") > F.col("upto") - F.col("words")) & (F.col("sample") <= F.col("upto")))
    at = at.select("src", "bin", (F.col("sample") - F.col("upto") + F.col("words")).alias("need"), "pi")
    edge = binned.withColumnRenamed("bin", "b").join(at, _same("source", "src") & (F.col("b") == F.col("bin")))
    ties = edge.withColumn("rank", _rank()).groupBy("src", "need", "rank").agg(F.sum("size").alias("tied"))
    upto = F.sum("tied").over(Window.partitionBy("src").orderBy("rank"))
    last = ties.withColumn("upto", upto).filter(
        (F.col("need") > F.col("upto") - F.col("tied")) & (F.col("need") <= F.col("upto")))
    last = last.select(F.col("src").alias("s"), F.col("rank").alias("edge"),
                       (F.col("need") - F.col("upto") + F.col("tied")).alias("rest"), "tied")
    return g.join(last, _same("src", "s"), "left").drop("s")


def decide(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``docs`` (source, size, u and any others) with source_size, target and taken."""
    d = docs.join(ends, _same("source", "src"))
    rank = _rank()
    more = (F.when(F.col("edge").isNull() | (rank > F.col("edge")), F.lit(0))
            .when(rank < F.col("edge"), F.col("size"))
            .otherwise(F.expr("(size * rest) div tied")))
    return d.withColumn("taken", (F.col("copies") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long")).drop(
        "src", "copies", "pi", "sample", "edge", "rest", "tied")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text with the white space before each."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, bins: int = 4096) -> DataFrame:
    """(id, size, source_size, target, taken) of every row."""
    docs = df.select(F.col(id_col), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                     uniform(F.col(id_col)).alias("u"))
    docs = materialize(docs)  # narrow; read by the sums, the boundary and the decision
    goal = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    ends = stored(boundaries(docs, goal, bins), "mix-ends")  # a row a source, of known size
    return decide(docs, ends).select(id_col, "size", "source_size", "target", "taken")


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            chars_col: str | None = "n_chars", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
            cap: float = 2.0, bins: int = 4096) -> DataFrame:
    """The mixed documents: a row for every copy taken, with all columns of the
    input; a part is the document's first words (white space as it was).

    Texts are read twice. The boundaries come from narrow columns and are a
    row a source: a written table, whose size lets Spark broadcast it below
    its threshold (then no text is shuffled) and else join it by source.
    """
    narrow = df.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                       uniform(F.col(id_col)).alias("u"))
    narrow = materialize(narrow)
    goal = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    ends = stored(boundaries(narrow, goal, bins), "mix-ends")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source_col).alias("source"),
                    n_words(F.col(text_col)).alias("size"), uniform(F.col(id_col)).alias("u"))
    got = decide(own, ends)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    words = F.array_append(F.array_repeat(F.lit(None).cast("long"), whole.cast("int")), part)
    copies = got.select("row", F.explode(words).alias("first")).filter(F.col("first").isNull() | (F.col("first") > 0))
    text = F.col(f"row.`{text_col}`")
    shown = F.when(F.col("first").isNull(), text).otherwise(first_words(text, F.col("first")))
    out = []
    for c in df.columns:
        if c == text_col:
            out.append(shown.alias(c))
        elif c == chars_col:
            out.append(F.char_length(shown).cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return copies.select(*out)
