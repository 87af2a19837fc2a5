"""Connected components of an edge table by alternating star contraction.

Large-star hangs every larger neighbour of a vertex on its smallest neighbour,
small-star does so with the smaller ones; alternated, every component becomes
one star around its smallest vertex. Only edges move (no neighbour list is
gathered), and every round ends in a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    e = edges.select("u", "v")
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        pairs, take = both, F.col("v") > F.col("u")
    else:
        pairs, take = both.filter(F.col("v") < F.col("u")), F.lit(True)
    # smallest vertex among a vertex and its neighbours: a partial minimum per task
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(least, "u").filter(take).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:  # the vertex itself hangs on its smallest neighbour too
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return hung.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex that has an edge; root is the smallest
    vertex of its component. Self-loops and null ends are ignored; an empty
    edge table gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(e)
    for _ in range(max_rounds if before[0] else 0):
        e = materialize(_star(_star(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
