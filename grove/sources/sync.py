"""Synchronising repositories: what the other side lacks, found by anti-joins on hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repository import SCHEMAS, Repository


def lacking(ours: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The part of a slice that the other side doesn't have."""
    keys = {"commits": ["hash"], "nodes": ["node_hash", "step"], "contents": ["hash"]}
    return {name: rows.join(theirs[name].select(*keys[name]), keys[name], "left_anti") for name, rows in ours.items()}


def convert(sliced: dict[str, DataFrame], value: str = "string") -> dict[str, DataFrame]:
    """A slice whose contents are read as another type and written as text again, keys kept;
    contents that don't read as that type are left out."""
    typed = F.col("value").try_cast(value)
    return {**sliced, "contents": sliced["contents"].where(typed.isNotNull()).withColumn("value", typed.cast("string"))}


def fetch(ours: Repository, theirs: Repository, branch: str, depth: int | None = None) -> str | None:
    """Import what a branch of another repository has and this one lacks; its head, None where
    the branch is empty. No branch moves.

    The other side sends its commits down to the heads that this side has, and of their trees
    only what is not here already.
    """
    head = theirs.head(branch)
    if head is None:
        return None
    have = ours.table("commits").select("hash")
    known = theirs.table("commits").join(have, "hash", "left_semi").where(F.col("hash").isin(sorted(set(ours.branches().values()))))
    sliced = theirs.export([head], [r.hash for r in known.select("hash").collect()], depth)
    # Heads that both sides have come along as ends of the slice, whole nodes or none.
    nodes = sliced["nodes"].join(ours.table("nodes").select("node_hash").distinct(), "node_hash", "left_anti")
    here = {name: ours.table(name) for name in sliced}
    ours.load({**lacking(sliced, here), "nodes": nodes})
    return head


def pull(ours: Repository, theirs: Repository, branch: str, into: str | None = None, info: tuple[int, str, str] | None = None, depth: int | None = None) -> str | None:
    """Fetch, then put the branch ``into`` (the same name where None) at the fetched head, or
    merge that head into it where ``info`` (date, author, message) is given."""
    head = fetch(ours, theirs, branch, depth)
    if head is None:
        return None
    if info is None:
        ours.set_head(into or branch, head)
        return head
    return ours.merge_commit(into or branch, head, *info)


def push(ours: Repository, theirs: Repository, branch: str, depth: int | None = None) -> str:
    """Send what the other repository lacks of a branch, and put its branch at our head."""
    if ours.head(branch) is None:
        raise ValueError(f"{branch} has no head to push")
    head = fetch(theirs, ours, branch, depth)
    theirs.set_head(branch, head)
    return head


def as_json(sliced: dict[str, DataFrame]) -> DataFrame:
    """``kind, json``: a slice as text, a row for each object."""
    out = None
    for name, rows in sliced.items():
        own = rows.select(F.lit(name).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("json"))
        out = own if out is None else out.unionByName(own)
    return out


def of_json(rows: DataFrame) -> dict[str, DataFrame]:
    """The slice that ``as_json`` wrote."""
    return {name: rows.where(F.col("kind") == name).select(F.from_json("json", schema).alias("o")).select("o.*") for name, schema in SCHEMAS.items()}
