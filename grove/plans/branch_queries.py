"""Queries over repositories: branches, their merges, slices and synchronisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import commits as C
from ..operators import graph as G
from ..operators import objects as O
from ..sources import sync
from ..sources.repository import Repository
from .derive import COMMITS, GEO, commits, geo, shown

INFO = (0, "TESTS", "")


def _repository(s: SparkSession) -> Repository:
    """A repository of its own in the shared folder."""
    return Repository(s, f"{G.shared_folder(s)}/repository-{uuid.uuid4().hex}")


def _edited(rows: DataFrame, *, drop: int, digit: int, to: str, name: str, more: int) -> DataFrame:
    """The order tree with an edit of its own: orders whose key ends in ``drop`` go, those that
    end in ``digit`` become ``to``, and some stand under /NEW too."""
    kept = rows.where(f"key % 10 <> {drop}").select("path", F.when(F.col("key") % 10 == digit, to).otherwise(F.col("value")).alias("value"), "metadata")
    return kept.unionByName(rows.where(f"key % 100 = {more}").select(F.array(F.lit("NEW"), F.lit(name), F.col("key").cast("string")).alias("path"), "value", "metadata"))


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree and two edits of it that don't clash."""
    rows = G.settle(geo(s, d))
    return rows.select("path", "value", "metadata"), _edited(rows, drop=1, digit=0, to="U", name="ours", more=5), _edited(rows, drop=2, digit=3, to="T", name="theirs", more=6)


_NEW = lambda name, n: f"select '/NEW/{name}/' || key, value, metadata from geo where key % 100 = {n}"
MERGED = f"with {GEO} select path, case key % 10 when 0 then 'U' when 3 then 'T' else value end as value, metadata from geo where key % 10 not in (1, 2) union all {_NEW('ours', 5)} union all {_NEW('theirs', 6)}"
THEIRS = f"with {GEO} select path, case key % 10 when 3 then 'T' else value end as value, metadata from geo where key % 10 <> 2 union all {_NEW('theirs', 6)}"


def _forked(s: SparkSession, d: str) -> Repository:
    """main and a clone of it, dev, with an edit on each."""
    base, ours, theirs = _sides(s, d)
    repo = _repository(s)
    repo.update("main", [], lambda _: base, *INFO)
    repo.clone("main", "dev")
    repo.update("main", [], lambda _: ours, 1, "TESTS", "ours")
    repo.update("dev", [], lambda _: theirs, 2, "TESTS", "theirs")
    return repo


def merge_into(s: SparkSession, d: str) -> DataFrame:
    repo = _forked(s, d)
    repo.merge_branch("main", "dev", *INFO)
    return shown(repo.checkout(repo.head("main")))


def merge_recursive(s: SparkSession, d: str) -> DataFrame:
    """Two branches that have each merged the other's first edit, edited again and merged: two
    lowest common ancestors, which are merged to be the ancestor."""
    repo = _forked(s, d)
    first = repo.head("main")
    repo.merge_branch("main", "dev", 3, "TESTS", "into main")
    repo.merge_commit("dev", first, 4, "TESTS", "into dev")
    edit = lambda digit, to: lambda tree: tree.withColumn("value", F.when(F.get(F.col("path"), F.size("path") - 1).cast("long") % 10 == digit, to).otherwise(F.col("value")))
    repo.update("main", [], edit(4, "P"), 5, "TESTS", "edit main")
    repo.update("dev", [], edit(5, "Q"), 6, "TESTS", "edit dev")
    repo.merge_branch("main", "dev", *INFO)
    return shown(repo.checkout(repo.head("main")))


def with_tree_merge(s: SparkSession, d: str) -> DataFrame:
    """An edit by ``with_tree`` that another edit of the branch overtakes."""
    base, ours, theirs = _sides(s, d)
    repo = _repository(s)
    repo.update("main", [], lambda _: base, *INFO)

    def slow(_: DataFrame | None) -> DataFrame:
        repo.update("main", [], lambda _: ours, 1, "TESTS", "meanwhile")
        return theirs

    repo.with_tree("main", [], slow, 2, "TESTS", "slow", strategy="merge")
    return shown(repo.checkout(repo.head("main")))


def branch_list(s: SparkSession, d: str) -> DataFrame:
    """A branch for each region but one, which is removed again; leaves under each head."""
    rows, repo = G.settle(geo(s, d)), _repository(s)
    names = [r.step for r in rows.select(F.get(F.col("path"), F.lit(0)).alias("step")).distinct().collect()]
    for name in names:
        branch = name.replace(" ", "_")
        own = rows.where(F.get(F.col("path"), F.lit(0)) == name).select("path", "value", "metadata")
        repo.update(f"region/{branch}", [], lambda _, own=own: own, *INFO)
    repo.set_head("region/ASIA", None)
    out = None
    for branch, head in repo.branches().items():
        one = repo.checkout(head).agg(F.lit(branch).alias("branch"), F.count("*").alias("leaves"))
        out = one if out is None else out.unionByName(one)
    return out


def sync_fetch(s: SparkSession, d: str) -> DataFrame:
    """What another repository's branch holds once it is fetched: its edit came over."""
    theirs = _forked(s, d)
    ours = _repository(s)
    sync.pull(ours, theirs, "main")
    return shown(ours.checkout(sync.fetch(ours, theirs, "dev")))


def sync_push(s: SparkSession, d: str) -> DataFrame:
    """A merge by pull in one repository, pushed back to the other."""
    theirs = _forked(s, d)
    ours = _repository(s)
    sync.pull(ours, theirs, "main")
    sync.pull(ours, theirs, "dev", into="main", info=INFO)
    sync.push(ours, theirs, "main")
    return shown(theirs.checkout(theirs.head("main")))


def slice_between(s: SparkSession, d: str) -> DataFrame:
    """Contents of the slice from the second of three commits on."""
    repo = _forked(s, d)
    first = repo.info(repo.head("main")).parents[0]
    repo.merge_branch("main", "dev", *INFO)
    part = repo.export([repo.head("main")], [repo.head("dev"), *[p for p in repo.info(repo.head("main")).parents if p != first]])
    return part["contents"].select("hash", "value").unionByName(part["commits"].agg(F.lit("commits").alias("hash"), F.count("*").cast("string").alias("value")))


def slice_convert(s: SparkSession, d: str) -> DataFrame:
    """A slice read as numbers: what is none is left out."""
    docs = geo(s, d).select(F.when(F.col("key") % 3 == 0, F.col("key").cast("string")).otherwise(F.col("value")).alias("value"))
    return sync.convert({"contents": O.store(docs)}, "bigint")["contents"]


def one_commit(s: SparkSession, d: str) -> DataFrame:
    repo = _forked(s, d)
    copy = repo.one_commit(repo.head("dev"), f"{repo.folder}-copy")
    return shown(copy.checkout(repo.head("dev")))


# Commits over customers over orders, as objects with names instead of hashes.
def _objects(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = G.settle(geo(s, d).select((F.col("key") % 90).alias("c"), F.get(F.col("path"), F.lit(2)).alias("customer"), F.col("key").cast("string").alias("leaf")))
    made = s.range(90).select(F.concat(F.lit("c"), F.col("id")).alias("hash"), F.concat(F.lit("root"), F.col("id")).alias("node_hash"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("c"), F.col("id") - 1), F.concat(F.lit("c"), F.floor(F.col("id") / 2)))).otherwise(F.array().cast("array<string>")).alias("parents"))
    roots = rows.select(F.concat(F.lit("root"), "c").alias("node_hash"), F.lit("node").alias("kind"), F.concat(F.lit("n"), "customer").alias("child_hash"))
    leaves = rows.select(F.concat(F.lit("n"), "customer").alias("node_hash"), F.lit("contents").alias("kind"), "leaf").withColumnRenamed("leaf", "child_hash")
    branches = s.createDataFrame([("main", "c89"), ("old", "c70")], "branch string, head string")
    return branches, made, roots.unionByName(leaves).distinct()


OBJECTS = """g as (select o_orderkey as key, cast(c_custkey as varchar) as customer from orders join customer on o_custkey = c_custkey),
edges as (
  select 'branch:main' as src, 'commit:c89' as dst union all select 'branch:old', 'commit:c70'
  union all select 'commit:c' || range, 'node:root' || range from range(90)
  union select 'commit:c' || range, 'commit:c' || (range - 1) from range(1, 90) union select 'commit:c' || range, 'commit:c' || (range // 2) from range(1, 90)
  union select 'node:root' || (key % 90), 'node:n' || customer from g union select 'node:n' || customer, 'contents:' || key from g)"""


def object_visits(s: SparkSession, d: str) -> DataFrame:
    """Objects from branch main down to branch old, whose commit keeps its tree."""
    edges = G.object_edges(*_objects(s, d))
    of = lambda *rows: s.createDataFrame(rows, "kind string, key string")
    return G.visits(edges, of(("branch", "main")), of(("branch", "old")), of(("node", "root80"))).select("kind", "key")


VISITS = f"""with recursive {OBJECTS},
walk as (select 'branch:main' as x union select dst from walk join edges on src = x where dst <> 'node:root80' and (x not in ('branch:old', 'commit:c70') or (x = 'commit:c70' and dst like 'node:%')))
select split_part(x, ':', 1) as kind, substr(x, instr(x, ':') + 1) as key from walk"""


def object_levels(s: SparkSession, d: str) -> DataFrame:
    """How many objects of each kind a visit of three levels meets, by level."""
    edges = G.object_edges(*_objects(s, d))
    found = G.visits(edges, s.createDataFrame([("commit", "c89")], "kind string, key string"), depth=3)
    return found.groupBy("kind", "level").agg(F.count("*").alias("n"))


LEVELS = f"""with recursive {OBJECTS}, walk as (select 'commit:c89' as x, 0 as level union select dst, level + 1 from walk join edges on src = x where level < 2),
f as (select x, min(level) as level from walk group by x) select split_part(x, ':', 1) as kind, level, count(*) as n from f group by all"""


def missing_objects(s: SparkSession, d: str) -> DataFrame:
    """Orders that customers hold and no table has: one in seven is gone."""
    _, _, nodes = _objects(s, d)
    entries = nodes.where("kind = 'contents'").select(F.col("node_hash").alias("src"), F.col("child_hash").alias("dst"))
    there = geo(s, d).where("key % 7 <> 0").select(F.col("key").cast("string").alias("hash"))
    return O.missing(entries, there)


def integrity_walk(s: SparkSession, d: str) -> DataFrame:
    """Damage under a branch: values that changed, values that are gone, by their text."""
    base, _, _ = _sides(s, d)
    repo = _repository(s)
    repo.update("main", [], lambda _: base, *INFO)
    whole = repo.table("contents")
    damaged = whole.where("value <> 'P'").withColumn("value", F.when(F.col("value") == "O", F.lit("!")).otherwise(F.col("value")))
    head = s.createDataFrame([("commit", repo.head("main"))], "kind string, key string")
    reached = G.visits(repo.edges(), head).select("kind", F.col("key").alias("hash"))
    found = O.problems(reached, repo.table("commits"), repo.table("nodes"), G.settle(damaged), "")
    return found.join(whole.select(F.col("hash").alias("key"), "value"), "key", "left").select("kind", "value", "problem")


def index_repair(s: SparkSession, d: str) -> DataFrame:
    values = O.store(geo(s, d).select(F.col("key").cast("string").alias("value")))
    index = values.select("hash").unionByName(s.range(25).select(F.sha1(F.concat(F.lit("gone"), F.col("id"))).alias("hash")))
    return O.repair(values, index)[1]


def lca_of_many(s: SparkSession, d: str) -> DataFrame:
    """One ancestor for the last commit, a tenth and a third of its number."""
    c = G.settle(commits(s, d))
    last = c.agg(F.max("commit")).first()[0]
    known = C.Virtual(c, lambda commit: geo(s, d).limit(0).select("path", "value", "metadata"))
    found = C.lca(known, [last, last // 3, last // 10])
    return s.range(1).select(F.lit(found).cast("long").alias("lca"))


QUERIES = {
    "merge_into": (merge_into, MERGED),
    "merge_recursive": (merge_recursive, f"with m as ({MERGED}) select path, case when right(path, 1) = '4' then 'P' when right(path, 1) = '5' then 'Q' else value end as value, metadata from m"),
    "with_tree_merge": (with_tree_merge, MERGED),
    "branch_list": (branch_list, "select 'region/' || replace(r_name, ' ', '_') as branch, count(*) as leaves from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA' group by all"),
    "sync_fetch": (sync_fetch, THEIRS),
    "sync_push": (sync_push, MERGED),
    "slice_between": (slice_between, f"with {GEO}, v as (select value from geo where key % 10 not in (1, 0) union select 'U' union select case key % 10 when 3 then 'T' else value end from geo where key % 10 <> 2 union select value from geo where key % 100 in (5, 6)) select sha1('B' || value) as hash, value from v union all select 'commits', '3'"),
    "slice_convert": (slice_convert, "select sha1('B' || o_orderkey) as hash, cast(o_orderkey as varchar) as value from orders join customer on o_custkey = c_custkey where o_orderkey % 3 = 0"),
    "one_commit": (one_commit, THEIRS),
    "object_visits": (object_visits, VISITS),
    "object_levels": (object_levels, LEVELS),
    "missing_objects": (missing_objects, "select cast(o_orderkey as varchar) as hash, count(distinct o_custkey) as referrers from orders join customer on o_custkey = c_custkey where o_orderkey % 7 = 0 group by o_orderkey"),
    "integrity_walk": (integrity_walk, "select 'contents' as kind, o_orderstatus as value, case o_orderstatus when 'P' then 'missing' else 'corrupted' end as problem from orders join customer on o_custkey = c_custkey where o_orderstatus in ('O', 'P') group by all"),
    "index_repair": (index_repair, "select 'fixed 25' as outcome, 25 as dropped, 0 as corrupted"),
    "lca_of_many": (lca_of_many, f"with recursive {COMMITS}, last as (select max(commit) as n from numbered), asked as (select n as a from last union select n // 3 from last union select n // 10 from last), anc as (select a, a as x from asked union select a, parent from anc join commits on x = commit where parent is not null), common as (select x from anc group by x having count(distinct a) = 3) select max(x) as lca from common"),
}
