"""Trees as tables of leaves: ``path, value, metadata``, one row for each path.

A path is never both a leaf and the beginning of another, and empty directories don't
exist, so every operation on trees is one on sets of leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashes, paths
from .graph import settle

LEAF = ("path", "value", "metadata")


def nodes(leaves: DataFrame) -> DataFrame:
    """Every directory once: ``path``. The prefixes of a task's leaves are thinned out before
    the shuffle."""
    return leaves.select(F.explode(paths.prefixes(F.col("path"))).alias("path")).distinct()


def children(leaves: DataFrame) -> DataFrame:
    """``parent, step, kind`` of every child of every directory."""
    n = F.size("path")
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.slice("path", 1, i - 1).alias("parent"), F.get(F.col("path"), i - 1).alias("step"), F.when(i == n, "contents").otherwise("node").alias("kind")))
    return leaves.where(n > 0).select(F.explode(steps).alias("c")).select("c.*").distinct()


def find(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """``path, value, metadata`` for each of ``keys`` (``path``): null where there is no leaf."""
    return keys.select("path").join(leaves.select(*LEAF), "path", "left")


def get(leaves: DataFrame, path: list[str]) -> str:
    """One value; raises where there is no leaf."""
    rows = leaves.where(F.col("path") == paths.literal(path)).select("value").take(1)
    if not rows:
        raise KeyError("/" + "/".join(path))
    return rows[0].value


def kinds(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """``path, kind`` for each of ``keys``: contents, node, or null. The root of a tree with
    any leaf is a node."""
    leaf = leaves.select("path", F.lit("contents").alias("kind"))
    return keys.select("path").join(leaf.unionByName(nodes(leaves).withColumn("kind", F.lit("node"))), "path", "left")


def subtree(leaves: DataFrame, path: list[str]) -> DataFrame:
    """The tree at ``path``, its paths from there; a leaf there has the empty path."""
    n = len(path)
    return leaves.where(paths.starts_with(F.col("path"), path)).withColumn("path", F.slice("path", n + 1, F.greatest(F.size("path") - n, F.lit(0))))


def listing(leaves: DataFrame, path: list[str], offset: int = 0, length: int | None = None) -> DataFrame:
    """``step, kind`` of the direct children in order, from ``offset`` on; none where
    ``path`` is a leaf or absent."""
    n = len(path)
    below = leaves.where(paths.starts_with(F.col("path"), path) & (F.size("path") > n))
    kind = F.when(F.max(F.size("path")) > n + 1, "node").otherwise("contents")
    page = below.groupBy(F.get(F.col("path"), F.lit(n)).alias("step")).agg(kind.alias("kind")).orderBy("step").offset(offset)
    return page if length is None else page.limit(length)


def lengths(leaves: DataFrame) -> DataFrame:
    """``path, children`` of every directory."""
    own = leaves.where(F.size("path") > 0).select("path").distinct().unionByName(nodes(leaves).where(F.size("path") > 0))
    return own.groupBy(paths.parent(F.col("path")).alias("path")).agg(F.count("*").alias("children"))


def _below(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """Leaves that no key is equal to or a prefix of. Equi-joins, one for each length that
    keys have."""
    for n in sorted(r.n for r in keys.select(F.size("path").alias("n")).distinct().collect()):
        own = keys.where(F.size("path") == n).select(F.col("path").alias("_key")).distinct()
        leaves = leaves.join(own, F.slice(leaves.path, 1, n) == F.col("_key"), "left_anti")
    return leaves


def remove(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the leaves and subtrees at ``keys``; directories left empty vanish, absent
    keys do nothing."""
    return _below(leaves, keys)


def add(leaves: DataFrame, updates: DataFrame) -> DataFrame:
    """With the leaves of ``updates`` (one row a path). A leaf on the way to a new one, and a
    subtree in its place, give way."""
    on_the_way = nodes(updates)
    return _below(leaves, updates).join(on_the_way, "path", "left_anti").select(*LEAF).unionByName(updates.select(*LEAF))


def update(leaves: DataFrame, keys: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """The value at each key becomes ``change(value)``; ``value`` is null where there is no
    leaf, and a null result removes."""
    new = find(leaves, keys).withColumn("value", change(F.col("value")))
    return add(remove(leaves, keys), new.where(F.col("value").isNotNull()))


def add_tree(leaves: DataFrame, path: list[str], tree: DataFrame) -> DataFrame:
    """``tree`` in place of what is at ``path``; an empty tree removes it."""
    here = leaves.sparkSession.range(1).select(paths.literal(path).alias("path"))
    placed = tree.select(F.concat(paths.literal(path), "path").alias("path"), "value", "metadata")
    way = nodes(placed)
    return remove(leaves, here).join(way, "path", "left_anti").select(*LEAF).unionByName(placed)


def _ups(ops: DataFrame) -> DataFrame:
    """Each operation with the places ``up``, its own and those above it, where one may be: at
    other lengths than operations have there is none, so few meet at the root."""
    lengths = sorted(r.n for r in ops.select(F.size("path").alias("n")).distinct().collect())
    at = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.size("path"))
    return ops.select("seq", "path", "value", "metadata", F.explode(F.transform(at, lambda n: F.slice("path", 1, n))).alias("up"))


def apply_batch(leaves: DataFrame, ops: DataFrame) -> DataFrame:
    """``ops`` (``seq, path, value, metadata``, a null value removes) in the order of ``seq``.

    An addition stays unless a later operation is at its path or above, or a later addition
    is below it. An old leaf stays unless some operation is at its path or above, or some
    addition below.
    """
    own = _ups(ops).where(F.col("value").isNotNull())
    latest = ops.groupBy(F.col("path").alias("up")).agg(F.max("seq").alias("above"))
    adds = ops.where(F.col("value").isNotNull())
    below = adds.select("seq", F.explode(paths.prefixes(F.col("path"))).alias("path")).groupBy("path").agg(F.max("seq").alias("below"))
    added = own.join(latest, "up", "left").groupBy("seq", "path").agg(F.max("above").alias("above"), F.first("value").alias("value"), F.first("metadata").alias("metadata"))
    added = added.join(below, "path", "left").where((F.col("above") <= F.col("seq")) & (F.coalesce("below", F.col("seq")) <= F.col("seq")))
    kept = _below(leaves, ops).join(below.select("path"), "path", "left_anti")
    return kept.select(*LEAF).unionByName(added.select(*LEAF))


def duplicates(leaves: DataFrame) -> DataFrame:
    """Paths that stand more than once or are also the beginning of another: what no tree
    can hold."""
    twice = leaves.groupBy("path").count().where("count > 1").select("path")
    return twice.unionByName(leaves.select("path").join(nodes(leaves), "path", "left_semi")).distinct()


def visits(leaves: DataFrame, relation: str = "le", depth: int | None = None, order: str | None = None, seed: int = 0) -> DataFrame:
    """``path, kind, depth`` of what a fold limited by depth visits; ``relation`` is one of
    eq, le, lt, ge, gt. A fold reaches the root before it looks at depths, so le and lt
    always visit it. ``order``: sorted (by path), random (by a hash with ``seed``) or none."""
    if order is not None:
        by = F.col("path") if order == "sorted" else F.xxhash64("path", F.lit(seed))
        return visits(leaves, relation, depth).orderBy(by)
    every = leaves.select("path", F.lit("contents").alias("kind")).unionByName(nodes(leaves).withColumn("kind", F.lit("node"))).withColumn("depth", F.size("path"))
    if depth is None:
        return every
    d = F.col("depth")
    rule = {"eq": d == depth, "le": d <= depth, "lt": d < depth, "ge": d >= depth, "gt": d > depth}[relation]
    return every.where(rule | (d == 0) if relation in ("le", "lt") else rule)


def stats(leaves: DataFrame) -> DataFrame:
    """One row: ``nodes, leafs, skips, depth, width``."""
    of_nodes = lengths(leaves).agg(F.count("*").alias("nodes"), F.coalesce(F.max("children"), F.lit(0)).alias("width"))
    of_leaves = leaves.agg(F.count("*").alias("leafs"), F.coalesce(F.max(F.size("path")), F.lit(0)).alias("depth"))
    return of_nodes.crossJoin(of_leaves).select("nodes", "leafs", F.lit(0).cast("long").alias("skips"), "depth", "width")


def neighbours(leaves: DataFrame) -> DataFrame:
    """``path, siblings``: for each leaf the other children met on its way from the root.

    Summed up from the root down, a join of directories a level, so no leaf meets every
    directory above it."""
    wide = settle(lengths(leaves))
    deepest = wide.agg(F.max(F.size("path"))).first()[0] or 0
    level = wide.where(F.size("path") == 0).select("path", (F.col("children") - 1).alias("siblings"))
    every = level
    for depth in range(1, deepest + 1):
        above = level.select(F.col("path").alias("_up"), F.col("siblings").alias("_above"))
        here = wide.where(F.size("path") == depth).withColumn("_up", paths.parent(F.col("path")))
        level = settle(here.join(above, "_up").select("path", (F.col("_above") + F.col("children") - 1).alias("siblings")))
        every = every.unionByName(level)
    way = leaves.where(F.size("path") > 0).select("path", paths.parent(F.col("path")).alias("_up"))
    return way.join(every.withColumnRenamed("path", "_up"), "_up").select("path", "siblings")


def node_hashes(leaves: DataFrame, deepest: int | None = None, pruned: DataFrame | None = None) -> DataFrame:
    """``path, kind, hash`` of every leaf and directory; of ``pruned`` parts (``path, kind, hash,
    metadata``) nothing but their hash is known.

    A leaf's hash is that of its contents. A directory's is a digest of the set of its
    entries (kind, step, hash, metadata), built from sums, so that a directory of any width
    is aggregated in parts and needs no sort. One aggregation a level, from the deepest up,
    each written down once.
    """
    entry = F.concat_ws("\x1f", "kind", "step", "hash", F.coalesce("metadata", F.lit("")))
    here = leaves.select("path", F.lit("contents").alias("kind"), hashes.contents(F.col("value")).alias("hash"), "metadata")
    if pruned is not None:
        here = here.unionByName(pruned.select("path", "kind", "hash", "metadata"))
    if deepest is None:
        deepest = here.agg(F.max(F.size("path"))).first()[0] or 0
    out, level = here.select("path", "kind", "hash"), here.where(F.size("path") == deepest)
    for depth in range(deepest, 0, -1):
        entries = level.select(F.slice("path", 1, depth - 1).alias("up"), F.get(F.col("path"), F.lit(depth - 1)).alias("step"), "kind", "hash", "metadata")
        found = entries.groupBy(F.col("up").alias("path")).agg(*hashes.set_sums(entry)).select("path", F.lit("node").alias("kind"), hashes.set_digest().alias("hash"), F.lit(None).cast("string").alias("metadata"))
        found = settle(found)  # the levels above and the result both read it
        out = out.unionByName(found.select("path", "kind", "hash"))
        level = found.unionByName(here.where(F.size("path") == depth - 1))
    return out


def settled(leaves: DataFrame) -> DataFrame:
    """``leaves`` written down with those of one directory side by side; a directory that is
    too wide for one task is dealt to several."""
    near = leaves.select(*LEAF, F.xxhash64(paths.parent(F.col("path"))).alias("_up"))
    return settle(near.hint("rebalance", F.col("_up")).drop("_up"))


def directory_hashes(leaves: DataFrame) -> DataFrame:
    """``path, hash`` of every directory, as ``node_hashes`` has them, written down."""
    found = node_hashes(leaves).where("kind = 'node'").select("path", "hash")
    return settle(found)


def hashes_at(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """``path, kind, hash`` of what is at each of ``keys``; nulls where there is nothing."""
    return keys.select("path").join(node_hashes(leaves), "path", "left")


def at_hashes(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """``hash, kind, path``: the first place, in order, of what has each hash of ``wanted``; nulls
    where nothing has it."""
    found = node_hashes(leaves).groupBy("hash", "kind").agg(F.min("path").alias("path"))
    return wanted.select("hash").distinct().join(found, "hash", "left")


def emptiness(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """``path, empty`` for each of ``keys``: contents are never empty, and a directory that
    exists isn't either."""
    return kinds(leaves, keys).select("path", F.col("kind").isNull().alias("empty"))


def update_tree(leaves: DataFrame, path: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` of the subtree at ``path`` (empty where there is none) in its place; an empty
    result removes it."""
    return add_tree(leaves, path, settle(change(subtree(leaves, path)).select(*LEAF)))


def fold(leaves: DataFrame, depth: int, start: Column, step: Callable[[Column, Column], Column], order: str = "sorted", seed: int = 0) -> DataFrame:
    """``path, acc``: for each directory ``depth`` steps down, ``start`` changed by ``step(acc,
    leaf)`` leaf after leaf (a struct of ``path`` from the root, ``value, metadata``).

    Orders are sorted, by path, and random, the same for the same seed. For steps that depend
    on order: the leaves of one such directory meet in one row. What can be added up in parts
    is ``groupBy`` and ``agg`` instead.
    """
    leaf = F.struct("path", "value", "metadata")
    key = {"sorted": F.struct(F.col("path").alias("k"), leaf.alias("v")), "random": F.struct(F.xxhash64("path", F.lit(seed)).alias("k"), leaf.alias("v"))}[order]
    rows = leaves.where(F.size("path") > depth).groupBy(F.slice("path", 1, depth).alias("path")).agg(F.sort_array(F.collect_list(key)).alias("all"))
    return rows.select("path", F.aggregate("all", start, lambda acc, x: step(acc, x["v"])).alias("acc"))


def prune(leaves: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A tree in which what is at ``keys`` is known by its hash alone: the leaves that are left,
    and ``path, kind, hash, metadata`` of the pruned parts."""
    marks = leaves.select(F.col("path").alias("_p"), "metadata")
    cut = settle(hashes_at(leaves, keys.distinct()).where("hash is not null").join(marks, F.col("path") == F.col("_p"), "left").drop("_p"))
    return remove(leaves, cut), cut


def find_pruned(leaves: DataFrame, pruned: DataFrame, keys: DataFrame) -> DataFrame:
    """``find`` in a pruned tree: a key at or below a pruned part is an error when it is read."""
    ups = keys.select("path", F.explode(F.concat(paths.prefixes(F.col("path")), F.array("path"))).alias("_up"))
    hidden = ups.join(pruned.select(F.col("path").alias("_up"), F.col("hash").alias("_h")), "_up").groupBy("path").agg(F.first("_h").alias("_h"))
    stop = F.raise_error(F.concat(F.lit("pruned hash "), F.col("_h"))).cast("string")
    return find(leaves, keys).join(hidden, "path", "left").withColumn("value", F.when(F.col("_h").isNull(), F.col("value")).otherwise(stop)).drop("_h")


def unique_visits(leaves: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``hash, path``: each different directory once, at its first path in order; ``seen``
    (``hash``) are marks of earlier folds."""
    dirs = node_hashes(leaves).where("kind = 'node'")
    if seen is not None:
        dirs = dirs.join(seen.select("hash"), "hash", "left_anti")
    return dirs.groupBy("hash").agg(F.min("path").alias("path"))


def equal(x: DataFrame, y: DataFrame) -> bool:
    """Whether two trees have the same root hash."""
    root = lambda t: [r.hash for r in node_hashes(t).where(F.size("path") == 0).select("hash").take(1)]
    return root(x) == root(y)
