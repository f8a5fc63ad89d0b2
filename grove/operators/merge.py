"""Structural diff and three-way merge of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import merges, paths
from .trees import nodes


# How conflicts of trees are named.
ADD_DEL, ADD_ADD, EMPTY = "option: add/del", "add/add values", "empty map"


def diff(x: DataFrame, y: DataFrame) -> DataFrame:
    """``path, kind, old_value, old_metadata, new_value, new_metadata`` of every leaf that
    differs; kind is added, removed or updated. One full outer join on the path."""
    a = x.select("path", F.struct("value", "metadata").alias("a"))
    b = y.select("path", F.struct("value", "metadata").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("updated")
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", kind.alias("kind"), F.col("a.value").alias("old_value"), F.col("a.metadata").alias("old_metadata"), F.col("b.value").alias("new_value"), F.col("b.metadata").alias("new_metadata"))


def patch(x: DataFrame, changes: DataFrame) -> DataFrame:
    """``x`` with a diff applied."""
    kept = x.join(changes.select("path"), "path", "left_anti").select("path", "value", "metadata")
    new = changes.where("kind <> 'removed'").select("path", F.col("new_value").alias("value"), F.col("new_metadata").alias("metadata"))
    return kept.unionByName(new)


def _sides(old: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """All leaves of both sides, and the ancestor's beside them: ``path, o, a, b``."""
    leaf = F.struct("metadata", "value")
    a, b = ours.select("path", leaf.alias("a")), theirs.select("path", leaf.alias("b"))
    return a.join(b, "path", "full_outer").join(old.select("path", leaf.alias("o")), "path", "left")


def merged(rows: DataFrame, contents: merges.Merge = merges.string_contents, metadata: merges.Merge = merges.default) -> Column:
    """The merge of ``o, a, b`` leaves: unchanged sides first, then metadata, then contents."""
    leaf = merges.option(merges.struct_of({"metadata": _lenient(metadata), "value": contents}))
    return leaf(F.col("o").isNotNull(), F.col("o"), F.col("a"), F.col("b"))


def _lenient(merge: merges.Merge) -> merges.Merge:
    """Metadata that both sides share needs no ancestor."""
    return lambda known, old, a, b: F.when(a.eqNullSafe(b), merges.done(a)).otherwise(merge(known, old, a, b))


def commit_mode(old: DataFrame, ours: DataFrame, theirs: DataFrame, contents: merges.Merge = merges.string_contents) -> DataFrame:
    """The merge of commits, leaf by leaf: ``path, value, metadata, conflict``. Leaves that
    are deleted are left out; where one side has a leaf and the other a directory, the
    directory wins."""
    rows = _sides(old, ours, theirs)
    out = rows.select("path", merged(rows, contents).alias("m"))
    out = out.where(~F.col("m.ok") | F.col("m.value").isNotNull())
    return out.join(nodes(out), "path", "left_anti").select("path", F.col("m.value.value").alias("value"), F.col("m.value.metadata").alias("metadata"), F.col("m.conflict").alias("conflict"))


def tree_conflicts(old: DataFrame, ours: DataFrame, theirs: DataFrame, contents: merges.Merge = merges.string_contents) -> DataFrame:
    """What keeps trees from merging step by step: ``path, conflict``.

    Besides leaves that clash: a directory that one side removed while the other changed
    anything in it (the highest such one is named), and a leaf on one side where the other
    has a directory.
    """
    rows = _sides(old, ours, theirs)
    leaves = rows.select("path", merged(rows, contents).alias("m")).where(~F.col("m.ok")).select("path", F.col("m.conflict").alias("conflict"))
    olds, mine, other = nodes(old), nodes(ours), nodes(theirs)

    def gone(side: DataFrame, side_leaves: DataFrame, changed: DataFrame) -> DataFrame:
        lost = olds.join(side, "path", "left_anti").join(side_leaves.select("path"), "path", "left_anti")
        top = lost.withColumn("up", paths.parent(F.col("path"))).join(side.select(F.col("path").alias("up")), "up", "left_semi").select("path")
        touched = changed.select(F.explode(paths.prefixes(F.col("path"))).alias("path")).distinct()
        return top.join(touched, "path", "left_semi").select("path", F.lit(ADD_DEL).alias("conflict"))

    missing = gone(mine, ours, diff(old, theirs)).unionByName(gone(other, theirs, diff(old, ours))).distinct()
    shapes = ours.join(other, "path", "left_semi").select("path").unionByName(theirs.join(mine, "path", "left_semi").select("path")).select("path", F.lit(ADD_ADD).alias("conflict"))
    inside = leaves.select("path", "conflict", F.explode(paths.prefixes(F.col("path"))).alias("up")).join(missing.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return leaves.join(inside, "path", "left_anti").unionByName(missing).unionByName(shapes).distinct()


def tree_mode(old: DataFrame | None, ours: DataFrame, theirs: DataFrame, contents: merges.Merge = merges.string_contents) -> DataFrame:
    """The merge of trees step by step: ``path, value, metadata`` of the merged tree. Raises
    ``MergeConflict`` where leaves or directories clash, and where nothing is left."""
    from .commits import MergeConflict
    from .graph import settle

    before = ours.limit(0) if old is None else old
    clash = tree_conflicts(before, ours, theirs, contents).orderBy("path").take(1)
    if clash:
        raise MergeConflict(clash[0].conflict)
    made = settle(commit_mode(before, ours, theirs, contents).select("path", "value", "metadata"))
    if made.isEmpty():
        raise MergeConflict(EMPTY)
    return made


def by_key(old: DataFrame, ours: DataFrame, theirs: DataFrame, contents: DataFrame, merge: merges.Merge = merges.string_contents) -> DataFrame:
    """Merges of contents that are known by their keys: ``id, hash, value, conflict`` for each
    ``id`` of ours and theirs (``id, hash``), over a store of contents (``hash, value``). The
    values are looked up, merged as absent where there is none, and hashed again."""
    from ..functions import hashes

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", "hash").join(contents.select("hash", "value"), "hash", "left").select("id", F.col("value").alias(name))

    rows = side(ours, "a").join(side(theirs, "b"), "id", "full_outer").join(side(old, "o"), "id", "left")
    m = merges.option(merge)(F.col("o").isNotNull(), F.col("o"), F.col("a"), F.col("b"))
    out = rows.select("id", m.alias("m")).where(~F.col("m.ok") | F.col("m.value").isNotNull())
    return out.select("id", hashes.contents(F.col("m.value")).alias("hash"), F.col("m.value").alias("value"), F.col("m.conflict").alias("conflict"))


def keyed(old: DataFrame | None, ours: DataFrame, theirs: DataFrame, key: str, value: str, merge: merges.Merge, absent_known: bool = True) -> DataFrame:
    """Association lists and maps, key by key over the keys of both sides: ``key, value,
    conflict``. ``absent_known``: without an ancestor list, keys count as known to be absent
    (lists), not as unknown (maps)."""
    v = lambda n: F.struct(F.col(value).alias("v")).alias(n)
    rows = ours.select(key, v("a")).join(theirs.select(key, v("b")), key, "full_outer")
    rows = rows.join(old.select(key, v("o")), key, "left") if old is not None else rows.withColumn("o", F.when(F.lit(False), F.col("a")))
    known = F.lit(True) if old is not None or absent_known else F.lit(False)
    out = rows.select(key, merges.option(merges.struct_of({"v": merge}))(known, F.col("o"), F.col("a"), F.col("b")).alias("m"))
    return out.where(~F.col("m.ok") | F.col("m.value").isNotNull()).select(key, F.col("m.value.v").alias(value), F.col("m.conflict").alias("conflict"))


def multiset(old: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Counts of both sides less the ancestor's; zeros vanish, negatives stay."""
    signed = lambda df, s: df.select(key, (F.col(count) * s).alias(count))
    return signed(ours, 1).unionByName(signed(theirs, 1)).unionByName(signed(old, -1)).groupBy(key).agg(F.sum(count).alias(count)).where(F.col(count) != 0)
