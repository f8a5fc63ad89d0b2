"""Queries over order trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import merges, paths
from ..operators import merge as M
from ..operators import trees as T
from .derive import GEO, VERSIONS, geo, shown, table, versions

PREFIXES = """dirs as (
  select distinct path, n from (
    select '/' as path, 0 as n from geo union all select '/' || s1, 1 from geo union all select '/' || s1 || '/' || s2, 2 from geo union all select '/' || s1 || '/' || s2 || '/' || s3, 3 from geo))"""
CHILDREN = """kids as (
  select distinct parent, step, kind from (
    select '/' as parent, s1 as step, 'node' as kind from geo union all select '/' || s1, s2, 'node' from geo
    union all select '/' || s1 || '/' || s2, s3, 'node' from geo union all select '/' || s1 || '/' || s2 || '/' || s3, s4, 'contents' from geo))"""


def _probes(s: SparkSession, d: str) -> DataFrame:
    """Leaves, directories and absent paths to ask for."""
    rows = geo(s, d)
    keys = rows.select("path").unionByName(rows.select(F.slice("path", 1, 3).alias("path"))).unionByName(rows.select(F.concat("path", F.array(F.lit("none"))).alias("path")))
    return keys.distinct()


PROBES = "probes as (select path from geo union select '/' || s1 || '/' || s2 || '/' || s3 from geo union select path || '/none' from geo)"


def tree_find(s: SparkSession, d: str) -> DataFrame:
    return shown(T.find(geo(s, d), _probes(s, d)))


def tree_kind(s: SparkSession, d: str) -> DataFrame:
    return shown(T.kinds(geo(s, d), _probes(s, d)))


def tree_subtree(s: SparkSession, d: str) -> DataFrame:
    return shown(T.subtree(geo(s, d), ["ASIA"]).select(*T.LEAF))


def tree_list_page(s: SparkSession, d: str) -> DataFrame:
    return T.listing(geo(s, d), ["ASIA"], 1, 3)


def tree_length(s: SparkSession, d: str) -> DataFrame:
    return shown(T.lengths(geo(s, d)))


def tree_contents(s: SparkSession, d: str) -> DataFrame:
    return shown(geo(s, d).select(*T.LEAF))


def _updates(s: SparkSession, d: str) -> DataFrame:
    """New leaves: one in place of a leaf, one in place of a directory, one below a leaf."""
    rows = geo(s, d).where("key % 97 = 0")
    at = F.when(F.col("key") % 3 == 0, F.col("path")).when(F.col("key") % 3 == 1, F.slice("path", 1, 3)).otherwise(F.concat("path", F.array(F.lit("new"))))
    return rows.select(at.alias("path"), F.lit("add").alias("value"), F.lit("m").alias("metadata")).distinct()


UPDATES = """updates as (
  select distinct case key % 3 when 0 then path when 1 then '/' || s1 || '/' || s2 || '/' || s3 else path || '/new' end as path, 'add' as value, 'm' as metadata from geo where key % 97 = 0)"""


def _plain_updates(s: SparkSession, d: str) -> DataFrame:
    """``_updates`` of which none stands below another."""
    u = _updates(s, d)
    return u.join(u.select(F.col("path").alias("up")), F.slice(u.path, 1, 3) == F.col("up"), "left_anti").unionByName(u.where(F.size("path") == 3))


PLAIN = "plain as (select * from updates u where not exists (select 1 from updates v where v.path <> u.path and starts_with(u.path, v.path || '/')))"


def tree_add(s: SparkSession, d: str) -> DataFrame:
    return shown(T.add(geo(s, d), _plain_updates(s, d)))


def tree_remove(s: SparkSession, d: str) -> DataFrame:
    keys = geo(s, d).where("key % 89 = 0").select(F.when(F.col("key") % 2 == 0, F.col("path")).otherwise(F.slice("path", 1, 3)).alias("path")).distinct()
    return shown(T.remove(geo(s, d), keys).select(*T.LEAF))


def tree_update(s: SparkSession, d: str) -> DataFrame:
    rows = geo(s, d)
    keys = rows.where("key % 10 = 4").select("path")
    return shown(T.update(rows, keys, lambda v: F.when(v == "F", None).otherwise(F.concat(v, F.lit("+")))))


def tree_add_tree(s: SparkSession, d: str) -> DataFrame:
    rows = geo(s, d)
    return shown(T.add_tree(rows, ["ASIA", "copy"], T.subtree(rows, ["EUROPE"])))


def batch_apply(s: SparkSession, d: str) -> DataFrame:
    rows = geo(s, d).where("key % 7 = 0")
    set_leaf = rows.select((F.col("key") * 3).alias("seq"), "path", F.lit("s").alias("value"), "metadata")
    drop_dir = rows.where("key % 2 = 0").select((F.col("key") * 3 + 1).alias("seq"), F.slice("path", 1, 3).alias("path"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("metadata"))
    deeper = rows.where("key % 3 = 0").select((F.col("key") * 3 + 2).alias("seq"), F.concat("path", F.array(F.lit("x"))).alias("path"), F.lit("d").alias("value"), "metadata")
    return shown(T.apply_batch(geo(s, d), set_leaf.unionByName(drop_dir).unionByName(deeper)))


BATCH = """ops as (
  select key * 3 as seq, path, 's' as value, metadata from geo where key % 7 = 0
  union all select key * 3 + 1, '/' || s1 || '/' || s2 || '/' || s3, null, null from geo where key % 14 = 0
  union all select key * 3 + 2, path || '/x', 'd', metadata from geo where key % 21 = 0),
ups as (select seq, value, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as up, path from ops),
added as (
  select o.path, o.value, o.metadata from ops o where o.value is not null
    and not exists (select 1 from ups u join ops l on l.path = u.up where u.seq = o.seq and l.seq > o.seq)
    and not exists (select 1 from ups l where l.up = o.path and l.path <> o.path and l.seq > o.seq and l.value is not null)),
leaf_ups as (select path, value, metadata, unnest([path, '/' || s1 || '/' || s2 || '/' || s3, '/' || s1 || '/' || s2, '/' || s1]) as up from geo),
hit as (select distinct path from leaf_ups join (select distinct path as op from ops) on up = op union select distinct up from ups where value is not null and path <> up)"""


def tree_invalid(s: SparkSession, d: str) -> DataFrame:
    rows = geo(s, d).select(*T.LEAF)
    return shown(T.duplicates(rows.unionByName(_updates(s, d)).unionByName(rows.where(F.col("metadata") == "1-URGENT"))))


def tree_fold_depth(s: SparkSession, d: str) -> DataFrame:
    return T.visits(geo(s, d), "le", 3).groupBy("kind", "depth").agg(F.count("*").alias("n"), F.min(paths.show(F.col("path"))).alias("first"))


def tree_fold_order(s: SparkSession, d: str) -> DataFrame:
    """Running count of each directory's children in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("parent").orderBy("step")
    return T.children(geo(s, d)).withColumn("place", F.row_number().over(w)).select(paths.show(F.col("parent")).alias("parent"), "step", "kind", "place")


def tree_stats(s: SparkSession, d: str) -> DataFrame:
    return T.stats(geo(s, d))


def stat_store_widths(s: SparkSession, d: str) -> DataFrame:
    rows = geo(s, d)
    wide = T.lengths(rows).agg(F.max("children").alias("width"), F.max_by(paths.show(F.col("path")), F.struct(F.col("children"), paths.show(F.col("path")))).alias("widest"))
    near = T.neighbours(rows).agg(F.max("siblings").alias("most_neighbours"))
    longest = rows.groupBy(F.size("path").alias("length")).count().agg(F.max("length").alias("longest"), F.max_by("count", "length").alias("n_longest"))
    return wide.crossJoin(near).crossJoin(longest)


def merkle_hashes(s: SparkSession, d: str) -> DataFrame:
    return shown(T.node_hashes(geo(s, d), 4).where("kind = 'node'")).select("path", "hash")


def _level(path: str, up: str, step: str, source: str) -> str:
    entry = f"concat_ws(chr(31), kind, {step}, hash, coalesce(metadata, ''))"
    return f"""select {path} as path, {up} as steps, 'node' as kind, sha1(count(*) || ',' || sum(cast('0x' || substr(sha1({entry}), 1, 15) as hugeint)) || ',' || sum(cast('0x' || substr(sha1({entry}), 16, 15) as hugeint))) as hash, cast(null as varchar) as metadata
    from {source} group by all"""


MERKLE = f"""with {GEO},
l4 as (select s1, s2, s3, s4, 'contents' as kind, sha1('B' || value) as hash, metadata from geo),
l3 as ({_level("'/' || s1 || '/' || s2 || '/' || s3", "[s1, s2, s3]", "s4", "l4")}),
l2 as ({_level("'/' || steps[1] || '/' || steps[2]", "[steps[1], steps[2]]", "steps[3]", "l3")}),
l1 as ({_level("'/' || steps[1]", "[steps[1]]", "steps[2]", "l2")}),
l0 as ({_level("'/'", "cast([] as varchar[])", "steps[1]", "l1")})
select path, hash from l3 union all select path, hash from l2 union all select path, hash from l1 union all select path, hash from l0"""


def _catalogue(s: SparkSession, d: str, sizes: str = "true") -> DataFrame:
    """A leaf for each size of a part type of a brand: many equal directories."""
    p = table(s, d, "part").where(sizes)
    return p.select(F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("path"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("metadata")).distinct()


def tree_fold_uniq(s: SparkSession, d: str) -> DataFrame:
    """Different directories of the second level, each with its first path."""
    return shown(T.unique_visits(_catalogue(s, d)).where(F.size("path") == 2)).select("path")


def tree_fold_uniq_all(s: SparkSession, d: str) -> DataFrame:
    """Different directories of any level, each with its first path."""
    return shown(T.unique_visits(_catalogue(s, d))).select("path")


UNIQ = """with leaves as (select distinct p_brand as b, p_type as t, cast(p_size as varchar) as s from part),
dirs as (select b, t, string_agg(s, ',' order by s) as entries from leaves group by all)
select '/' || min(struct_pack(b := b, t := t)).b || '/' || min(struct_pack(b := b, t := t)).t as path from dirs group by entries"""
UNIQ_ALL = UNIQ + """ union all select '/' || min(b) from (select b, string_agg(t || '=' || entries, ';' order by t) as whole from dirs group by b) group by whole union all select '/'"""


def tree_diff(s: SparkSession, d: str) -> DataFrame:
    base, ours, _ = versions(s, d)
    return shown(M.diff(base, ours))


def diff_patch(s: SparkSession, d: str) -> DataFrame:
    """Applying a diff gives the other tree."""
    base, _, theirs = versions(s, d)
    return shown(M.patch(base, M.diff(base, theirs)))


def tree_equal(s: SparkSession, d: str) -> DataFrame:
    base, ours, _ = versions(s, d)
    same = lambda x, y, n: M.diff(x, y).agg((F.count("*") == 0).alias("same")).select(F.lit(n).alias("pair"), "same")
    return same(base, base, "base base").unionByName(same(base, ours, "base ours"))


def merge_commit_mode(s: SparkSession, d: str) -> DataFrame:
    return shown(M.commit_mode(*versions(s, d)))


SIDES = """sides as (
  select path, o.value as o, ours.value as a, theirs.value as b, coalesce(ours.metadata, theirs.metadata) as metadata, o.path is not null as known
  from ours full outer join theirs using (path) left join base o using (path))"""


def merge_tree_conflicts(s: SparkSession, d: str) -> DataFrame:
    return shown(M.tree_conflicts(*versions(s, d)))


CONFLICTS = f"""with {VERSIONS}, {SIDES},
up as (select distinct path, up from (select path, unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as up from (select path from base union select path from ours union select path from theirs))),
bd as (select distinct up as path from up join base using (path)), od as (select distinct up as path from up join ours using (path)), td as (select distinct up as path from up join theirs using (path)),
oc as (select distinct up as path from up join (select path from base full outer join ours using (path) where base.value is distinct from ours.value or base.metadata is distinct from ours.metadata) using (path)),
tc as (select distinct up as path from up join (select path from base full outer join theirs using (path) where base.value is distinct from theirs.value or base.metadata is distinct from theirs.metadata) using (path)),
parent as (select path, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/') as up from bd),
gone as (
  select path from parent where path not in (select path from od) and path in (select path from tc) and (up = '/' or up in (select path from od))
  union select path from parent where path not in (select path from td) and path in (select path from oc) and (up = '/' or up in (select path from td))),
leaf as (
  select path, case when a is null or b is null then 'option: add/del' else 'default' end as conflict from sides
  where (a is not null and b is not null and a <> b and (not known or (o <> a and o <> b))) or (known and a is null and b <> o) or (known and b is null and a <> o))
select path, conflict from leaf where path not in (select path from up where up in (select path from gone)) union all select path, 'option: add/del' from gone"""

_MERGED = """case when not known then case when a is null then b when b is null or a = b then a end
    when o is not distinct from a then b when o is not distinct from b then a when a = b then a end"""
_CLASH = "(a is not null and b is not null and a <> b and (not known or (o <> a and o <> b))) or (known and (a is null) <> (b is null) and coalesce(a, b) <> o)"

def tree_is_empty(s: SparkSession, d: str) -> DataFrame:
    return shown(T.emptiness(geo(s, d), _probes(s, d)))


def tree_hash_at(s: SparkSession, d: str) -> DataFrame:
    """Hashes of some directories and absent paths."""
    keys = _probes(s, d).where((F.size("path") == 3) | (F.get(F.col("path"), F.size("path") - 1) == "none"))
    return shown(T.hashes_at(geo(s, d), keys))


def tree_of_hash(s: SparkSession, d: str) -> DataFrame:
    """Where contents with each status stand first, and a hash that nothing has."""
    wanted = s.createDataFrame([("O",), ("F",), ("P",), ("none",)], "value string").select(F.sha1(F.concat(F.lit("B"), "value")).alias("hash"))
    return shown(T.at_hashes(geo(s, d), wanted))


def tree_update_tree(s: SparkSession, d: str) -> DataFrame:
    """Europe without its even orders; Africa emptied, so it vanishes; a new continent."""
    odd = T.update_tree(geo(s, d).select(*T.LEAF), ["EUROPE"], lambda t: t.where(F.get(F.col("path"), F.size("path") - 1).cast("long") % 2 == 1))
    none = T.update_tree(odd, ["AFRICA"], lambda t: t.limit(0))
    asia = T.subtree(geo(s, d).select(*T.LEAF), ["ASIA"])
    return shown(T.update_tree(none, ["ATLANTIS"], lambda t: t.unionByName(asia)))


def tree_fold(s: SparkSession, d: str) -> DataFrame:
    """For each customer the states of its orders in the order of their names."""
    found = T.fold(geo(s, d), 3, F.lit(""), lambda acc, leaf: F.concat(acc, F.substring(leaf["metadata"], 1, 1), leaf["value"]))
    return shown(found)


def tree_visit_random(s: SparkSession, d: str) -> DataFrame:
    """A fold in random order visits the same."""
    return shown(T.visits(geo(s, d), "le", 3, order="random", seed=7))


def tree_prune(s: SparkSession, d: str) -> DataFrame:
    """A tree whose parts under Asia and Europe are known by their hashes; its root is the same."""
    rows = geo(s, d)
    keys = s.createDataFrame([(["ASIA"],), (["EUROPE"],), (["none"],)], "path array<string>")
    left, cut = T.prune(rows, keys)
    root = T.node_hashes(left, pruned=cut).where(F.size("path") == 0)
    return shown(cut.select("path", "hash").unionByName(root.select("path", "hash")).unionByName(left.agg(F.array(F.lit("left")).alias("path"), F.count("*").cast("string").alias("hash"))))


def diff_root_contents(s: SparkSession, d: str) -> DataFrame:
    """Trees that are contents alone, and trees against contents."""
    rows = geo(s, d).select(*T.LEAF)
    leaf = lambda value: s.range(1).select(paths.literal([]).alias("path"), F.lit(value).alias("value"), F.lit(None).cast("string").alias("metadata"))
    both = M.diff(leaf("a"), leaf("b")).withColumn("case", F.lit("contents"))
    grown = M.diff(leaf("a"), rows).withColumn("case", F.lit("tree"))
    return shown(both.unionByName(grown))


QUERIES = {
    "tree_find": (tree_find, f"with {GEO}, {PROBES} select path, value, metadata from probes left join (select path, value, metadata from geo) using (path)"),
    "tree_kind": (tree_kind, f"with {GEO}, {PROBES}, {PREFIXES} select path, kind from probes left join (select path, 'contents' as kind from geo union all select path, 'node' from dirs) using (path)"),
    "tree_subtree": (tree_subtree, f"with {GEO} select '/' || s2 || '/' || s3 || '/' || s4 as path, value, metadata from geo where s1 = 'ASIA'"),
    "tree_list_page": (tree_list_page, f"with {GEO} select distinct s2 as step, 'node' as kind from geo where s1 = 'ASIA' order by 1 limit 3 offset 1"),
    "tree_length": (tree_length, f"with {GEO}, {CHILDREN} select parent as path, count(*) as children from kids group by all"),
    "tree_contents": (tree_contents, f"with {GEO} select path, value, metadata from geo"),
    "tree_add": (tree_add, f"with {GEO}, {UPDATES}, {PLAIN} select path, value, metadata from plain union all select path, value, metadata from geo g where path not in (select path from plain) and '/' || s1 || '/' || s2 || '/' || s3 not in (select path from plain) and path || '/new' not in (select path from plain)"),
    "tree_remove": (tree_remove, f"with {GEO}, gone as (select case when key % 2 = 0 then path else '/' || s1 || '/' || s2 || '/' || s3 end as path from geo where key % 89 = 0) select path, value, metadata from geo where path not in (select path from gone) and '/' || s1 || '/' || s2 || '/' || s3 not in (select path from gone)"),
    "tree_update": (tree_update, f"with {GEO} select path, case when key % 10 = 4 then value || '+' else value end as value, metadata from geo where not (key % 10 = 4 and value = 'F')"),
    "tree_add_tree": (tree_add_tree, f"with {GEO} select path, value, metadata from geo union all select '/ASIA/copy/' || s2 || '/' || s3 || '/' || s4, value, metadata from geo where s1 = 'EUROPE'"),
    "batch_apply": (batch_apply, f"with {GEO}, {BATCH} select path, value, metadata from added union all select path, value, metadata from geo where path not in (select path from hit)"),
    "tree_invalid": (tree_invalid, f"with {GEO}, {UPDATES}, every as (select path from geo union all select path from updates union all select path from geo where metadata = '1-URGENT') select path from every group by path having count(*) > 1 union select u.path from updates u where exists (select 1 from geo g where '/' || g.s1 || '/' || g.s2 || '/' || g.s3 = u.path) or exists (select 1 from updates v where v.path = u.path || '/new') union select path from geo where path || '/new' in (select path from updates)"),
    "tree_fold_depth": (tree_fold_depth, f"with {GEO}, {PREFIXES} select 'node' as kind, n as depth, count(*) as n, min(path) as first from dirs group by all"),
    "tree_fold_order": (tree_fold_order, f"with {GEO}, {CHILDREN} select parent, step, kind, row_number() over (partition by parent order by step) as place from kids"),
    "tree_stats": (tree_stats, f"with {GEO}, {CHILDREN} select (select count(distinct parent) from kids) as nodes, (select count(*) from geo) as leafs, 0 as skips, 4 as depth, (select max(n) from (select count(*) as n from kids group by parent)) as width"),
    "stat_store_widths": (stat_store_widths, f"with {GEO}, {CHILDREN}, w as (select parent, count(*) as n from kids group by parent), near as (select sum(n - 1) as siblings from (select path, unnest(['/', '/' || s1, '/' || s1 || '/' || s2, '/' || s1 || '/' || s2 || '/' || s3]) as parent from geo) join w using (parent) group by path) select (select max(n) from w) as width, (select parent from w order by n desc, parent desc limit 1) as widest, (select max(siblings) from near) as most_neighbours, 4 as longest, (select count(*) from geo) as n_longest"),
    "merkle_hashes": (merkle_hashes, MERKLE),
    "tree_fold_uniq": (tree_fold_uniq, UNIQ),
    "tree_fold_uniq_all": (tree_fold_uniq_all, UNIQ_ALL),
    "tree_diff": (tree_diff, f"with {VERSIONS} select path, case when b.path is null then 'added' when o.path is null then 'removed' else 'updated' end as kind, b.value as old_value, b.metadata as old_metadata, o.value as new_value, o.metadata as new_metadata from base b full outer join ours o using (path) where b.value is distinct from o.value or b.metadata is distinct from o.metadata"),
    "diff_patch": (diff_patch, f"with {VERSIONS} select path, value, metadata from theirs"),
    "tree_equal": (tree_equal, "select 'base base' as pair, true as same union all select 'base ours', false"),
    "merge_commit_mode": (merge_commit_mode, f"with {VERSIONS}, {SIDES} select path, case when {_CLASH} then null else {_MERGED} end as value, case when {_CLASH} then null else metadata end as metadata, case when {_CLASH} then case when a is null or b is null then 'option: add/del' else 'default' end end as conflict from sides where ({_CLASH}) or ({_MERGED}) is not null"),
    "merge_tree_conflicts": (merge_tree_conflicts, CONFLICTS),
    "tree_is_empty": (tree_is_empty, f"with {GEO}, {PROBES} select path, path like '%/none' as empty from probes"),
    "tree_hash_at": (tree_hash_at, MERKLE[: MERKLE.rindex("select path, hash from l3 union all")] + "select path, 'node' as kind, hash from l3 union all select path || '/none', null, null from geo"),
    "tree_of_hash": (tree_of_hash, f"with {GEO}, f as (select value, min((s1, s2, s3, s4)) as p from geo group by value) select sha1('B' || value) as hash, 'contents' as kind, '/' || p[1] || '/' || p[2] || '/' || p[3] || '/' || p[4] as path from f union all select sha1('Bnone'), null, null"),
    "tree_update_tree": (tree_update_tree, f"with {GEO} select path, value, metadata from geo where s1 <> 'AFRICA' and (s1 <> 'EUROPE' or key % 2 = 1) union all select '/ATLANTIS' || substr(path, 6), value, metadata from geo where s1 = 'ASIA'"),
    "tree_fold": (tree_fold, f"with {GEO} select '/' || s1 || '/' || s2 || '/' || s3 as path, string_agg(substr(metadata, 1, 1) || value, '' order by s4) as acc from geo group by all"),
    "tree_visit_random": (tree_visit_random, f"with {GEO} select '/' as path, 'node' as kind, 0 as depth union all select distinct '/' || s1, 'node', 1 from geo union all select distinct '/' || s1 || '/' || s2, 'node', 2 from geo union all select distinct '/' || s1 || '/' || s2 || '/' || s3, 'node', 3 from geo"),
    "tree_prune": (tree_prune, MERKLE[: MERKLE.rindex("select path, hash from l3 union all")] + "select path, hash from l1 where path in ('/ASIA', '/EUROPE') union all select path, hash from l0 union all select '/left', cast(count(*) as varchar) from geo where s1 not in ('ASIA', 'EUROPE')"),
    "diff_root_contents": (diff_root_contents, f"with {GEO} select 'contents' as \"case\", '/' as path, 'updated' as kind, 'a' as old_value, null as old_metadata, 'b' as new_value, null as new_metadata union all select 'tree', '/', 'removed', 'a', null, null, null union all select 'tree', path, 'added', null, null, value, metadata from geo"),
}
