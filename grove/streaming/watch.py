"""Watches: changes of branch heads as streams, with the last head of each branch as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "branch string, seq long, kind string, before string, after string"


def _events(branch: str, last: str | None, rows: pd.DataFrame) -> tuple[list, str | None]:
    out = []
    for seq, head in zip(rows["seq"], rows["head"], strict=True):
        head = None if pd.isna(head) else head
        if head != last:
            kind = "added" if last is None else "removed" if head is None else "updated"
            out.append((branch, seq, kind, last, head))
            last = head
    return out, last


def watch(heads: DataFrame, branch: str | None = None) -> DataFrame:
    """A stream of ``branch, seq, head`` (null: removed) to one of events. A head equal to the
    last seen one is no event; the state is one string a branch."""
    rows = heads if branch is None else heads.where(F.col("branch") == branch)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        every = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out, last = _events(key[0], last, every)
        state.update((last,))
        yield pd.DataFrame(out, columns=["branch", "seq", "kind", "before", "after"])

    return rows.select("branch", "seq", "head").groupBy("branch").applyInPandasWithState(step, EVENT, "head string", "append", GroupStateTimeout.NoTimeout)


def replay(heads: DataFrame) -> DataFrame:
    """The events of a finished list of heads, as ``watch`` gives them."""
    w = Window.partitionBy("branch").orderBy("seq")
    before, after = F.lag("head").over(w), F.col("head")
    rows = heads.select("branch", "seq", before.alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("updated")
    return rows.select("branch", "seq", kind.alias("kind"), "before", "after")


def watch_key(events: DataFrame, values: DataFrame) -> DataFrame:
    """``branch, seq, kind, old, new`` of the value at one key (``values``: ``head, value``)
    at each event of a head; no event where it stays the same or is absent on both sides."""
    side = lambda name, as_: values.select(F.col("head").alias(name), F.col("value").alias(as_))
    rows = events.select("branch", "seq", "before", "after").join(side("before", "old"), "before", "left").join(side("after", "new"), "after", "left")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("updated")
    return rows.where(~F.col("old").eqNullSafe(F.col("new"))).select("branch", "seq", kind.alias("kind"), "old", "new")


def lift(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Events of heads as events of commits (``hash``): a head that no commit has counts as
    absent, so an update becomes an addition or a removal, and where both are unknown there
    is no event."""
    side = lambda name, as_: commits.select(F.col("hash").alias(name), F.col("hash").alias(as_))
    rows = events.select("branch", "seq", "before", "after").join(side("before", "old"), "before", "left").join(side("after", "new"), "after", "left")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("updated")
    return rows.where(F.col("old").isNotNull() | F.col("new").isNotNull()).select("branch", "seq", kind.alias("kind"), F.col("old").alias("before"), F.col("new").alias("after"))
