"""Proofs: the part of a tree that some paths need, the rest as hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes, paths
from .graph import settle
from .merge import diff
from .trees import node_hashes, nodes


def entries(leaves: DataFrame, deepest: int | None = None, hashed: DataFrame | None = None) -> DataFrame:
    """``parent, step, kind, hash, metadata`` of every entry of every directory; ``hashed`` is
    the tree's ``node_hashes`` where it is known already."""
    hashed = (node_hashes(leaves, deepest) if hashed is None else hashed).where(F.size("path") > 0)
    marked = hashed.join(leaves.select("path", "metadata"), "path", "left")
    return marked.select(paths.parent(F.col("path")).alias("parent"), paths.last(F.col("path")).alias("step"), "kind", "hash", "metadata")


def prove(leaves: DataFrame, keys: DataFrame, deepest: int | None = None) -> DataFrame:
    """``parent, step, kind, hash, metadata, value, blinded``: the entries of all directories
    on the way to ``keys`` (``path``), with the values at the keys; entries off the way stand
    for what is below them by their hash alone."""
    way = nodes(keys)
    rows = entries(leaves, deepest).join(way.withColumnRenamed("path", "parent"), "parent", "left_semi")
    here = F.concat("parent", F.array("step"))
    open_paths = way.unionByName(keys.select("path")).distinct().withColumn("open", F.lit(True))
    rows = rows.withColumn("path", here).join(open_paths, "path", "left").join(leaves.join(keys.select("path"), "path", "left_semi").select("path", "value"), "path", "left")
    return rows.select("parent", "step", "kind", "hash", "metadata", "value", F.col("open").isNull().alias("blinded"))


def root(proof: DataFrame) -> str | None:
    """The root hash that a proof stands for: opened contents are hashed from their values,
    opened directories from their entries, from the deepest up."""
    depth = proof.agg(F.max(F.size("parent"))).first()[0]
    if depth is None:
        return None
    entry = F.concat_ws("\x1f", "kind", "step", "hash", F.coalesce("metadata", F.lit("")))
    known: DataFrame | None = None
    for d in range(depth, -1, -1):
        rows = proof.where(F.size("parent") == d).withColumn("hash", F.when(F.col("value").isNotNull(), hashes.contents(F.col("value"))).otherwise(F.col("hash")))
        if known is not None:
            rows = rows.withColumn("path", F.concat("parent", F.array("step"))).join(known, "path", "left").withColumn("hash", F.coalesce("below", "hash"))
        known = rows.groupBy(F.col("parent").alias("path")).agg(*hashes.set_sums(entry)).select("path", hashes.set_digest().alias("below"))
    return known.select("below").first()[0]


def verify(proof: DataFrame, before: str) -> bool:
    """Whether a proof stands for the tree with this root hash."""
    return root(proof) == before


class ProofMismatch(ValueError):
    """A proof is not of that tree, does not lead to that result, or lacks a part that is read."""


def to_tree(proof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of a proof: its known leaves, and the parts that it knows by hash alone."""
    here = proof.withColumn("path", F.concat("parent", F.array("step")))
    known = here.where("not blinded and value is not null").select("path", "value", "metadata")
    return known, here.where("blinded").select("path", "kind", "hash", "metadata")


def tree_root(leaves: DataFrame, pruned: DataFrame) -> str | None:
    """The root hash of a tree with pruned parts."""
    row = node_hashes(leaves, pruned=pruned).where(F.size("path") == 0).select("hash").first()
    return row[0] if row else None


def run(proof: DataFrame, before: str, change: Callable[[DataFrame], DataFrame], after: str) -> DataFrame:
    """Run ``change`` on the leaves that a proof knows, and return them. Raises ``ProofMismatch``
    if the proof isn't of the tree ``before``, if a changed path lies in a part known by its
    hash alone, or if the changed tree isn't ``after``."""
    if not verify(proof, before):
        raise ProofMismatch("the proof is of another tree")
    known, pruned = (settle(x) for x in to_tree(proof))
    made = settle(change(known).select("path", "value", "metadata"))
    moved = diff(known, made).select(F.explode(F.concat(paths.prefixes(F.col("path")), F.array("path"))).alias("path"))
    below = moved.join(pruned.select("path"), "path", "left_semi")
    if not below.isEmpty():
        raise ProofMismatch("a part that is known by its hash alone is needed")
    if tree_root(made, pruned) != after:
        raise ProofMismatch("the result is another tree")
    return made
