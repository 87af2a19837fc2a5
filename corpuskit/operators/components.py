"""Connected components of a table of links.

Every vertex is hung on the smallest neighbour it knows, in turns that look at
larger neighbours only and at smaller ones only, until each component is a star
around its smallest vertex. Only rows of two vertices move; a round takes a
minimum per vertex (combined map-side) and one join, whose skew AQE splits, and
ends in a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialize

MOST_ROUNDS = 64


def _linked(pairs: DataFrame) -> DataFrame:
    """(high, low) of links between different vertices, once each."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _hang_larger(links: DataFrame) -> DataFrame:
    """Neighbours above a vertex go to the smallest vertex that it knows, itself included."""
    seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _linked(seen.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _hang_smaller(links: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours go to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return _linked(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root) of every vertex with a link to another one; ``root`` is the
    smallest vertex of its component (a row of its own as well)."""
    now = materialize(_linked(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state(now)
    for _ in range(MOST_ROUNDS):
        if not last[0]:
            break
        now = materialize(_hang_smaller(_hang_larger(now)))
        found = state(now)
        if found == last:
            break
        last = found
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
