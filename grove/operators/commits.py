"""Merges of commits: common ancestors that are merged themselves, then a three-way merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import merges
from . import graph, merge

Trees = Callable[[object], DataFrame]

# How conflicts of commits are named.
RECURSIVE, TOO_MANY, TOO_DEEP = "Recursive merging of common ancestors: ", "Too many lcas", "Max depth reached"


class MergeConflict(ValueError):
    """Two trees don't merge; the text says why."""


def _lcas(commits: DataFrame, a, b, max_depth: int | None = None, n: int | None = None) -> list:
    """The lowest common ancestors of two commits, in order: a handful, whatever the history."""
    kind = commits.schema["commit"].dataType
    pair = commits.sparkSession.range(1).select(F.lit(a).cast(kind).alias("a"), F.lit(b).cast(kind).alias("b"))
    return sorted(r.lca for r in graph.lcas(commits, pair, max_depth, n).collect())


class Virtual:
    """Commits, and those that merges of ancestors make on the way: they have trees and
    parents, but nobody keeps them."""

    def __init__(self, commits: DataFrame, trees: Trees):
        self.commits, self.trees, self.made = commits, trees, {}

    def tree(self, commit) -> DataFrame:
        return self.made[commit] if commit in self.made else self.trees(commit)

    def add(self, a, b, tree: DataFrame):
        kind = self.commits.schema["commit"].dataType
        name = f"{a}+{b}" if kind.typeName() == "string" else -1 - len(self.made)
        rows = self.commits.sparkSession.range(1).select(F.lit(name).cast(kind).alias("commit"), F.explode(F.array(F.lit(a), F.lit(b)).cast(f"array<{kind.simpleString()}>")).alias("parent"))
        self.commits = self.commits.select("commit", "parent").unionByName(rows)
        self.made[name] = tree
        return name

    def parents(self, commit) -> list:
        return [r.parent for r in self.commits.where((F.col("commit") == F.lit(commit)) & F.col("parent").isNotNull()).select("parent").distinct().collect()]


def three_way(known: Virtual, a, b, contents: merges.Merge = merges.string_contents, max_depth: int | None = None, n: int | None = None):
    """The commit that merges ``a`` and ``b``: one of them, or a new one of ``known``.

    A commit that is a parent of the other gives way to it, and so does one that is the
    ancestor. Several lowest common ancestors are merged among themselves first, without
    limits. Limits that are hit, and ancestors that clash, leave the merge without an
    ancestor. Raises ``MergeConflict``.
    """
    if a == b:
        return a
    try:
        found = _lcas(known.commits, a, b, max_depth, n)
    except graph.LcaError:
        found = []
    if a in known.parents(b):
        return b
    if b in known.parents(a):
        return a
    old = None
    try:
        for x in found:
            old = x if old is None else three_way(known, old, x, contents)
    except MergeConflict:
        old = None
    if old is not None and old == a:
        return b
    if old is not None and old == b:
        return a
    ours, theirs = known.tree(a), known.tree(b)
    before = ours.limit(0) if old is None else known.tree(old)
    made = graph.settle(merge.commit_mode(before, ours, theirs, contents))
    clash = made.where("conflict is not null").orderBy("path").select("conflict").take(1)
    if clash:
        raise MergeConflict(RECURSIVE + clash[0].conflict)
    return known.add(a, b, made.select("path", "value", "metadata"))


def lca(known: Virtual, commits: list, contents: merges.Merge = merges.string_contents, max_depth: int | None = None, n: int | None = None):
    """One commit for the common past of several, folded from the left: of two commits their
    lowest common ancestor, or the merge of these where there are more. None where there is
    none, or where ancestors clash. Limits that are hit raise ``MergeConflict``."""
    if not commits:
        raise MergeConflict("History.lca: empty")
    out = commits[0]
    for other in commits[1:]:
        if out == other:
            continue
        try:
            found = _lcas(known.commits, out, other, max_depth, n)
        except graph.LcaError as why:
            raise MergeConflict(TOO_MANY if "too_many" in str(why) else TOO_DEEP) from why
        if not found:
            return None
        out = found[0]
        for x in found[1:]:
            try:
                out = three_way(known, out, x, contents, max_depth, n)
            except MergeConflict:
                return None
    return out
