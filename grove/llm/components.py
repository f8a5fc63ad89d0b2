"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, written


def _star(links: DataFrame) -> DataFrame:
    """One large star, then one small star: links to ever smaller neighbours. The centre of a
    large star is a hot key of the first join, whose other side has a row a key: adaptive
    execution splits it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """``(a, b)`` links of longs to ``(node, root)``, root the smallest node reachable.

    Nodes without a link to another node don't appear. Each round is written to the shared
    folder; the driver sees a count and a sum a round. The rounds grow with the logarithm of
    the longest chain.
    """
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), tag)
    before = state(links)
    while before[0]:
        mark = written()
        links = materialize(_star(links), tag)
        after = state(links)
        discard(links.sparkSession, mark - 1, mark)  # the round before
        if after == before:
            break
        before = after
    # At the end every link leads from a node to its root.
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
