"""Commit graphs: ``commit, parent`` edges (a null parent: none) and searches over them.

Every search is a loop over whole frontiers: one join with the edges a round, distinct
nodes, and the rounds bounded by depth. The visited table is written to the shared folder
every few rounds, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import heapq
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUNDS = 4  # between writes of the visited table


class LcaError(ValueError):
    """``max_depth_reached`` or ``too_many_lcas``."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only on a local
    master one of this machine is set where there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="grove-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/grove-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """``origin, node, level`` of everything reachable from ``starts`` (``origin, node``) along
    ``edges`` (``src, dst``), each once at its lowest level. Nodes at ``depth`` and nodes of
    ``stop`` (``node``) are reached but not gone beyond."""
    seen = settle(starts.select("origin", "node", F.lit(0).alias("level")).distinct())
    level = 0
    while depth is None or level < depth:
        front = seen.where(F.col("level") == level)
        if stop is not None:
            front = front.join(stop.select("node"), "node", "left_anti")
        new = front.join(edges.where("dst is not null"), F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        new = settle(new.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("level", F.lit(level + 1)))
        if new.isEmpty():
            break
        level += 1
        seen = seen.unionByName(new)
        if level % ROUNDS == 0:
            seen = settle(seen)
    return seen


def jumps(edges: DataFrame) -> DataFrame:
    """``src, dst, hops``: the edges of a graph without cycles, and from each node the ends of
    2, 4, 8, ... hops along one chosen edge a node, found by pointer doubling."""
    edges = settle(edges.where("dst is not null").select("src", "dst", F.lit(1).cast("long").alias("hops")).distinct())
    # Later commits have greater numbers as a rule, so the greatest parent makes long chains.
    last = settle(edges.groupBy("src").agg(F.max("dst").alias("dst"), F.max("hops").alias("hops")))
    most, length, out = last.count(), 1, edges
    while 2 * length <= most:
        then = last.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("hops").alias("_more"))
        last = settle(last.join(then, "dst").select("src", F.col("_to").alias("dst"), (F.col("hops") + F.col("_more")).alias("hops")))
        if last.isEmpty():
            break
        out, length = out.unionByName(last), 2 * length
    return settle(out.groupBy("src", "dst").agg(F.min("hops").alias("hops")))


def reach_far(edges: DataFrame, starts: DataFrame, levels: bool = True) -> DataFrame:
    """``reach`` to any depth over a graph without cycles, in rounds that grow with the
    logarithm of its chains: rows go over ``jumps``. With ``levels`` the search goes on while
    a lower level is found; without, levels are of the path that was found first."""
    hops = jumps(edges)
    seen = front = settle(starts.select("origin", "node", F.lit(0).cast("long").alias("level")).distinct())
    while True:
        new = front.join(hops, F.col("node") == F.col("src")).groupBy("origin", F.col("dst").alias("node")).agg(F.min(F.col("level") + F.col("hops")).alias("level"))
        known = new.join(seen.withColumnRenamed("level", "_known"), ["origin", "node"], "left")
        better = F.col("_known").isNull() | (F.col("level") < F.col("_known")) if levels else F.col("_known").isNull()
        front = settle(known.where(better).select("origin", "node", "level"))
        if front.isEmpty():
            return seen
        seen = settle(seen.join(front.select("origin", "node"), ["origin", "node"], "left_anti").unionByName(front))


def parents(commits: DataFrame) -> DataFrame:
    """Commit edges as ``src, dst``."""
    return commits.select(F.col("commit").alias("src"), F.col("parent").alias("dst")).where("dst is not null")


def history(commits: DataFrame, head: int, depth: int | None = None, least: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (``commit, level``) and edges (``parent, commit``) of the past of ``head``;
    nothing is gone beyond ``depth`` levels or the commits of ``least``."""
    start = commits.sparkSession.range(1).select(F.lit(0).alias("origin"), F.lit(head).cast("long").alias("node"))
    past = reach_far(parents(commits), start) if depth is None and least is None else reach(parents(commits), start, depth, least)
    found = past.select(F.col("node").alias("commit"), "level")
    kept = found.select("commit")
    edges = commits.where("parent is not null").select("parent", "commit").distinct().join(kept, "commit", "left_semi").join(kept.withColumnRenamed("commit", "parent"), "parent", "left_semi")
    return found, edges


def closure(commits: DataFrame, most: DataFrame, least: DataFrame, depth: int | None = None) -> DataFrame:
    """``commit`` of all between ``most`` and ``least`` (``commit``): ``most`` always, and what
    they reach without going beyond ``least``."""
    starts = most.select(F.lit(0).alias("origin"), F.col("commit").alias("node"))
    stop = least.select(F.col("commit").alias("node"))
    if depth is not None:
        return reach(parents(commits), starts, depth, stop).select(F.col("node").alias("commit"))
    # Not going beyond a commit is a graph in which nothing leads out of it.
    inside = parents(commits).join(stop, F.col("src") == F.col("node"), "left_anti")
    return reach_far(inside, starts, levels=False).select(F.col("node").alias("commit"))


def lcas(commits: DataFrame, pairs: DataFrame, max_depth: int | None = None, n: int | None = None) -> DataFrame:
    """``a, b, lca`` of each pair (``a, b``): common ancestors, a commit being its own, that
    no other common ancestor descends from. All pairs are searched together.

    ``max_depth`` below zero, or a pair whose pasts go on at that depth without an answer,
    raises ``LcaError``; so do ``n`` of zero or less and more than ``n`` answers.
    """
    if max_depth is not None and max_depth < 0:
        raise LcaError("max_depth_reached")
    if n is not None and n <= 0:
        raise LcaError("too_many_lcas")
    heads = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    edges = parents(commits)
    starts = heads.select(F.col("node").alias("origin"), "node")
    past = reach_far(edges, starts, levels=False) if max_depth is None else settle(reach(edges, starts, max_depth))
    if max_depth is not None:
        cut = past.where(F.col("level") == max_depth).join(edges, F.col("node") == F.col("src"), "left_semi").select("origin").distinct()
    side = lambda name: past.select(F.col("origin").alias(name), F.col("node").alias("lca"))
    common = settle(pairs.distinct().join(side("a"), "a").join(side("b"), ["b", "lca"]).select("a", "b", "lca"))
    # A common ancestor is no lowest one if a child of it is a common ancestor too.
    above = edges.select(F.col("src").alias("child"), F.col("dst").alias("lca"))
    beaten = common.join(above, "lca").join(common.select("a", "b", F.col("lca").alias("child")), ["a", "b", "child"], "left_semi").select("a", "b", "lca")
    out = common.join(beaten, ["a", "b", "lca"], "left_anti")
    if max_depth is not None:
        open_pairs = pairs.where("a <> b").join(out.select("a", "b"), ["a", "b"], "left_anti")
        if not open_pairs.join(cut, (F.col("origin") == F.col("a")) | (F.col("origin") == F.col("b")), "left_semi").isEmpty():
            raise LcaError("max_depth_reached")
    if n is not None and not out.groupBy("a", "b").count().where(F.col("count") > n).isEmpty():
        raise LcaError("too_many_lcas")
    return out


def fast_forwards(commits: DataFrame, moves: DataFrame) -> DataFrame:
    """``head, target, result`` of moving a branch (``head, target``): ok where the head is the
    only lowest common ancestor, no_change where they are equal, rejected else; a branch
    without a head takes any commit."""
    found = lcas(commits, moves.where("head is not null").select(F.col("head").alias("a"), F.col("target").alias("b")))
    per = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("lca").alias("lca"))
    rows = moves.join(per, (F.col("head") == F.col("a")) & (F.col("target") == F.col("b")), "left")
    result = F.when(F.col("head").isNull(), "ok").when(F.col("head") == F.col("target"), "no_change").when((F.col("n") == 1) & (F.col("lca") == F.col("head")), "ok").otherwise("rejected")
    return rows.select("head", "target", result.alias("result"))


def ends(edges: DataFrame) -> DataFrame:
    """``node, place`` of nodes that nothing leads to (max) or from (min), of ``src, dst``."""
    src, dst = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).where("node is not null").distinct()
    return src.join(dst, "node", "left_anti").withColumn("place", F.lit("max")).unionByName(dst.join(edges.where("dst is not null").select(F.col("src").alias("node")), "node", "left_anti").withColumn("place", F.lit("min")))


def modifications(writes: DataFrame, inherited: DataFrame) -> DataFrame:
    """``commit, key, date`` of commits whose value at a key differs from every parent's.

    ``writes`` (``commit, date, key, value``): what each commit wrote, a null value for a
    removal; ``inherited`` (``commit, key, value``): what its parents have at these keys, a
    row for each parent, which may be left out for a parent without the key unless the
    commit removes it. A commit is left out if a parent has the same.
    """
    i = inherited.select(F.col("commit").alias("_c"), F.col("key").alias("_k"), F.col("value").alias("_v"))
    same = (F.col("commit") == F.col("_c")) & (F.col("key") == F.col("_k")) & F.col("value").eqNullSafe(F.col("_v"))
    return writes.join(i, same, "left_anti").select("commit", "key", "date")


def last_modified(writes: DataFrame, inherited: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` latest commits that changed each key: ``key, commit, place``, latest first."""
    w = Window.partitionBy("key").orderBy(F.desc("date"), F.desc("commit"))
    return modifications(writes, inherited).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("key", "commit", "place")


def object_edges(branches: DataFrame, commits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src_kind, src, dst_kind, dst``: what each object leads to by itself. A branch (``branch,
    head``) to its commit, a commit (``hash, node_hash, parents``) to its root node and its
    parents, a node (``node_hash, kind, child_hash``) to its entries."""
    kind = lambda name: F.lit(name)
    of_branch = branches.where("head is not null").select(kind("branch").alias("src_kind"), F.col("branch").alias("src"), kind("commit").alias("dst_kind"), F.col("head").alias("dst"))
    of_root = commits.select(kind("commit").alias("src_kind"), F.col("hash").alias("src"), kind("node").alias("dst_kind"), F.col("node_hash").alias("dst"))
    of_parent = commits.select(kind("commit").alias("src_kind"), F.col("hash").alias("src"), kind("commit").alias("dst_kind"), F.explode("parents").alias("dst"))
    of_node = nodes.select(kind("node").alias("src_kind"), F.col("node_hash").alias("src"), F.col("kind").alias("dst_kind"), F.col("child_hash").alias("dst"))
    return of_branch.unionByName(of_root).unionByName(of_parent).unionByName(of_node).distinct()


def _reach_kinds(own: DataFrame, starts: DataFrame) -> DataFrame:
    """``reach_far`` over ``src_kind, src, dst_kind, dst``. Objects of a kind that leads nowhere,
    as contents, take no part in the search: one join at its end finds them."""
    rows = settle(own)
    leading = [r[0] for r in rows.select("src_kind").distinct().collect()]
    last = ~F.col("dst_kind").isin(leading)
    inner = settle(reach_far(rows.where(~last).select("src", "dst"), starts))
    met = inner.join(rows.where(last).select("src", "dst"), F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), (F.col("level") + 1).alias("level"))
    return inner.unionByName(met).groupBy("origin", "node").agg(F.min("level").alias("level"))


def visits(edges: DataFrame, most: DataFrame, least: DataFrame | None = None, skip: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """``kind, key, level`` of all objects from ``most`` (``kind, key``) on, each at its lowest
    level, over edges as of ``object_edges`` or of the caller's own making.

    What is in ``skip`` is not visited; levels of ``depth`` and more are not reached. What is
    in ``least`` is visited, but contents and nodes in it are not gone beyond, and a commit in
    it cuts the history and keeps its tree; a branch in it stands for its commit as well.
    """
    name = lambda kind, key: F.concat_ws(":", kind, key)
    own = edges.select("src_kind", "dst_kind", name("src_kind", "src").alias("src"), name("dst_kind", "dst").alias("dst"))
    starts = most.select(F.lit(0).alias("origin"), name("kind", "key").alias("node"))
    if skip is not None:
        gone = skip.select(name("kind", "key").alias("gone"))
        own = own.join(gone, F.col("dst") == F.col("gone"), "left_anti")
        starts = starts.join(gone, F.col("node") == F.col("gone"), "left_anti")
    if least is not None:
        end = least.select(name("kind", "key").alias("end"))
        heads = own.where("src_kind = 'branch'").join(end, F.col("src") == F.col("end")).select(F.col("dst").alias("end"))
        end = settle(end.unionByName(heads).distinct())
        beyond = own.join(end, F.col("src") == F.col("end"), "left_anti")
        trees = own.where("src_kind = 'commit' and dst_kind <> 'commit'").join(end, F.col("src") == F.col("end"), "left_semi")
        own = beyond.unionByName(trees)
    if depth is None:
        found = _reach_kinds(own, starts)
    else:
        found = reach(own.select("src", "dst"), starts, depth - 1) if depth > 0 else starts.limit(0).withColumn("level", F.lit(0))
    return found.select(F.substring_index("node", ":", 1).alias("kind"), F.expr("substring(node, instr(node, ':') + 1)").alias("key"), F.col("level").cast("long").alias("level"))


def first_changes(commits: DataFrame, values: DataFrame, head: object, n: int = 1, depth: int | None = None) -> list:
    """Up to ``n`` commits that changed one key, as a walk from ``head`` meets them: the latest
    open commit (``commit, parent, date``) next, reported if its value (``values``: ``commit,
    value``) differs from every parent's, and the commits found last come first.

    A commit without parents ends the walk, reported if it has a value. Nothing is known of a
    commit twice, so ancestors that are shared can be met again. Parents of commits ``depth``
    steps away are compared but not walked to. The walk is the driver's; it holds the open
    commits and looks up a frontier's rows at a time.
    """
    known: dict = {}

    def look_up(wanted: list) -> None:
        ask = [c for c in wanted if c not in known]
        if ask:
            rows = commits.where(F.col("commit").isin(ask)).groupBy("commit").agg(F.collect_set("parent").alias("parents"), F.max("date").alias("date"))
            for r in rows.join(values.select("commit", "value"), "commit", "left").collect():
                known[r["commit"]] = (sorted(r["parents"]), r["date"], r["value"])

    look_up([head])
    heap, found, number = [(-known[head][1], 0, head, 0)], [], 1
    while heap and len(found) < n:
        # Everything that stands open is looked up at once, so a line of commits is the worst case.
        _, _, here, steps = heapq.heappop(heap)
        ancestors, _, value = known[here]
        if not ancestors:
            return [here, *found] if value is not None else found
        look_up([*ancestors, *(p for _, _, c, _ in heap for p in known[c][0])])
        if all(known[p][2] != value for p in ancestors):
            found = [here, *found]
        if depth is None or steps < depth:
            for p in ancestors:
                heapq.heappush(heap, (-known[p][1], number, p, steps + 1))
                number += 1
    return found
