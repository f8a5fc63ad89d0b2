"""Mergeable containers: counters, registers and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach_far


def counters(deltas: DataFrame, key: str, delta: str) -> DataFrame:
    """``key, value``: the sum of all increments, in any order and from any branch."""
    return deltas.groupBy(key).agg(F.sum(delta).alias("value"))


def registers(writes: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``key, ts, value`` of the last write; of equal times the greater value."""
    return writes.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value"))).alias("w")).select(key, "w.ts", "w.value")


def merge_logs(old: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, ts: str) -> DataFrame:
    """Logs as rows: the ancestor's entries, and those of either side that are newer than its
    newest; ``place`` counts from the newest. Entries of both sides with equal times stay.

    The merge is by columns of the rows, so ``place`` is the only thing that needs a key's
    rows in order.
    """
    newest = old.groupBy(key).agg(F.max(ts).alias("_newest"))
    later = ours.unionByName(theirs).join(newest, key, "left").where(F.col("_newest").isNull() | (F.col(ts) > F.col("_newest"))).drop("_newest")
    rest = [c for c in old.columns if c not in (key, ts)]
    w = Window.partitionBy(key).orderBy(F.desc(ts), *[F.desc(c) for c in rest])
    return old.unionByName(later).withColumn("place", F.row_number().over(w))


def read_log(entries: DataFrame, key: str, ts: str, after: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """A page of each log, newest first: up to ``n`` entries older than the cursor in ``after``
    (``key, cursor``); logs without a cursor are read from their newest entry."""
    rows = entries
    if after is not None:
        rows = rows.join(after.select(key, "cursor"), key, "left").where(F.col("cursor").isNull() | (F.col(ts) < F.col("cursor"))).drop("cursor")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts))))
    return rows if n is None else rows.where(F.col("place") <= n)


def next_cursors(page: DataFrame, key: str, ts: str) -> DataFrame:
    """``key, cursor``: where the page after this one of each log starts. Logs that the page
    has nothing of are at their end."""
    return page.groupBy(key).agg(F.min(ts).alias("cursor"))


def linked_log(links: DataFrame, heads: DataFrame, ts: str = "ts") -> DataFrame:
    """``log, node, place`` and the other columns of every entry of each log, newest first.

    ``links``: ``node, before`` (an array of nodes: none, one, or both heads that a merge
    joined), ``ts``, and what an entry holds; a merge is a node with a null ``ts`` and is no
    entry. ``heads``: ``log, node``. Entries that both sides of a merge share are read once.
    """
    edges = links.select(F.col("node").alias("src"), F.explode("before").alias("dst"))
    found = reach_far(edges, heads.select(F.col("log").alias("origin"), "node"), levels=False)
    rows = found.select(F.col("origin").alias("log"), "node").join(links.drop("before"), "node").where(F.col(ts).isNotNull())
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("log").orderBy(F.desc(ts), F.desc("node"))))
