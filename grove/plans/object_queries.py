"""Queries over commit graphs and content-addressed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes, paths
from ..operators import graph as G
from ..operators import objects as O
from .derive import COMMITS, commits, geo, shown, table


def _head(c: DataFrame) -> int:
    return c.agg(F.max("commit")).first()[0]


def commit_history(s: SparkSession, d: str) -> DataFrame:
    c = G.settle(commits(s, d))
    return G.history(c, _head(c), 12)[0]


def commit_history_edges(s: SparkSession, d: str) -> DataFrame:
    c = G.settle(commits(s, d))
    return G.history(c, _head(c), 8)[1]


_WALK = """walk as (select max(commit) as commit, 0 as level from numbered union select parent, level + 1 from walk join commits using (commit) where parent is not null and level < {n}),
found as (select commit, min(level) as level from walk group by commit)"""


def commit_closure(s: SparkSession, d: str) -> DataFrame:
    """Between the last commit and those that end in 00: a cut that the short cuts go round."""
    c = G.settle(commits(s, d))
    least = c.where("commit % 50 = 0").select("commit").distinct()
    return G.closure(c, s.range(1).select(F.lit(_head(c)).alias("commit")), least)


def lcas_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every hundredth commit, and the one half as far again."""
    c = G.settle(commits(s, d))
    return G.lcas(c, c.where("commit % 100 = 7").select(F.col("commit").alias("a"), F.floor(F.col("commit") * 2 / 3).cast("long").alias("b")).distinct())


def fast_forward(s: SparkSession, d: str) -> DataFrame:
    c = G.settle(commits(s, d))
    moves = c.where("commit % 100 = 1").select(F.when(F.col("commit") > 1, F.col("commit")).alias("head"), F.least(F.col("commit") + F.col("commit") % 3 * 20, F.lit(_head(c))).alias("target")).distinct()
    return G.fast_forwards(c, moves)


def commit_history_all(s: SparkSession, d: str) -> DataFrame:
    """The whole past of the last commit."""
    c = G.settle(commits(s, d))
    return G.history(c, _head(c))[0]


def _mirrored(c: DataFrame) -> DataFrame:
    """``a, b``: every fiftieth commit and the one as far from the other end of the table."""
    return c.where("commit % 50 = 0").select(F.col("commit").alias("a"), (F.lit(_head(c) + 1) - F.col("commit")).alias("b")).distinct()


def lcas_pairs_all(s: SparkSession, d: str) -> DataFrame:
    c = G.settle(commits(s, d))
    return G.lcas(c, _mirrored(c))


def fast_forward_all(s: SparkSession, d: str) -> DataFrame:
    c = G.settle(commits(s, d))
    return G.fast_forwards(c, _mirrored(c).select(F.col("a").alias("head"), F.col("b").alias("target")))


_ANC = """heads as (select a as h from pairs union select b from pairs), anc as (select h as a, h as x from heads union select a, parent from anc join commits on x = commit where parent is not null),
common as (select p.a, p.b, u.x from pairs p join anc u on u.a = p.a join anc v on v.a = p.b and v.x = u.x),
lca as (select a, b, x as lca from common c where not exists (select 1 from common e join commits k on k.commit = e.x where k.parent = c.x and e.a = c.a and e.b = c.b))"""
_MOVED = "select head, target, case when head is null then 'ok' when head = target then 'no_change' when (select count(*) from lca where a = head and b = target) = 1 and (select min(lca) from lca where a = head and b = target) = head then 'ok' else 'rejected' end as result from moves"


def graph_ends(s: SparkSession, d: str) -> DataFrame:
    return G.ends(commits(s, d).where("commit % 100 <> 0").select(F.col("commit").alias("src"), F.col("parent").alias("dst")))


def heads(s: SparkSession, d: str) -> DataFrame:
    """Branches by event type: the last event is the head."""
    return table(s, d, "events").groupBy(F.col("event_type").alias("branch")).agg(F.max("event_id").alias("head"), F.count("*").alias("commits")).where(paths.valid_branch(F.col("branch")))


def last_modified(s: SparkSession, d: str) -> DataFrame:
    """A line of commits, one an event; each writes one key of a user."""
    e = table(s, d, "events").select(F.col("event_id").alias("commit"), F.col("event_id").alias("date"), F.concat_ws("/", F.lit(""), F.col("user_id").cast("string"), F.col("event_type")).alias("key"), F.round("value", 0).alias("value"))
    before = e.withColumn("value", F.lag("value").over(Window.partitionBy("key").orderBy("commit"))).where("value is not null")
    return G.last_modified(e, before, 2)


LAST = """with e as (select event_id as commit, '/' || user_id || '/' || event_type as key, round(value, 0) as value from events),
m as (select key, commit from (select *, lag(value) over (partition by key order by commit) as before from e) where before is distinct from value)
select key, commit, place from (select *, row_number() over (partition by key order by commit desc) as place from m) where place <= 2"""


def cas_dedup(s: SparkSession, d: str) -> DataFrame:
    return O.store(table(s, d, "documents"), "text").select("hash", F.length("value").alias("size"))


def cas_verify(s: SparkSession, d: str) -> DataFrame:
    """Look-ups of all documents in a store whose every tenth value was damaged."""
    kept = O.store(table(s, d, "documents"), "text")
    damaged = kept.withColumn("value", F.when(F.col("hash") < "1", F.concat("value", F.lit("!"))).otherwise(F.col("value"))).where("hash < 'e'")
    keys = table(s, d, "documents").select("doc_id", hashes.contents(F.col("text")).alias("hash"))
    return keys.join(O.lookup(damaged, keys.select("hash").distinct()), "hash").select("doc_id", "hash", "intact")


def integrity_check(s: SparkSession, d: str) -> DataFrame:
    kept = O.store(table(s, d, "documents"), "text")
    return O.integrity(kept.withColumn("value", F.when(F.col("hash") < "1", F.concat("value", F.lit("!"))).otherwise(F.col("value"))))


def index_check(s: SparkSession, d: str) -> DataFrame:
    scan = table(s, d, "documents").select(F.sha1(F.col("doc_id").cast("string")).alias("hash"), (F.col("doc_id") * 10).alias("offset"))
    index = table(s, d, "documents").where("doc_id % 9 <> 0").select(F.sha1((F.col("doc_id") + F.when(F.col("doc_id") % 31 == 0, 1000000).otherwise(0)).cast("string")).alias("hash"), (F.col("doc_id") * 10 + F.when(F.col("doc_id") % 17 == 0, 5).otherwise(0)).alias("offset"))
    return O.index_check(scan, index)


def traversal_stats(s: SparkSession, d: str) -> DataFrame:
    objects = table(s, d, "documents").select(F.lit("contents").alias("kind"), F.sha1("text").alias("hash")).unionByName(geo(s, d).select(F.lit("node").alias("kind"), F.sha1(F.array_join(F.slice("path", 1, 3), "/")).alias("hash")))
    return O.kinds(objects)


def slice_import(s: SparkSession, d: str) -> DataFrame:
    """Documents of one half imported into a store of the other."""
    half = lambda n: O.store(table(s, d, "documents").where(F.col("doc_id") % 2 == n), "text")
    return O.import_slice(half(0), half(1)).select("hash")


def _live(s: SparkSession, d: str, first: int, end: int) -> DataFrame:
    """Leaves that commits ``first`` to ``end`` - 1 of ninety reach, of trees that share customers."""
    rows = geo(s, d)
    edges = rows.select(F.concat(F.lit("c"), (F.col("key") % 90).cast("string")).alias("src"), F.sha1(F.array_join(F.slice("path", 1, 3), "/")).alias("dst")).unionByName(rows.select(F.sha1(F.array_join(F.slice("path", 1, 3), "/")).alias("src"), F.sha1(F.array_join("path", "/")).alias("dst"))).distinct()
    roots = s.range(first, end).select(F.lit(0).alias("origin"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("node"))
    return G.reach(edges, roots).groupBy("level").agg(F.count("*").alias("live"))


def gc_live(s: SparkSession, d: str) -> DataFrame:
    """From two commits, as in its SQL."""
    return _live(s, d, 60, 62)


def gc_live_all(s: SparkSession, d: str) -> DataFrame:
    """From the last third of the commits."""
    return _live(s, d, 60, 90)


_RANGES = "select distinct l_orderkey * 40 + l_linenumber * 5 as off, cast(l_quantity as bigint) % 9 + 1 as len from lineitem"


def _ranges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 40 + F.col("l_linenumber") * 5).alias("off"), (F.col("l_quantity").cast("long") % 9 + 1).alias("len"))


def gc_ranges(s: SparkSession, d: str) -> DataFrame:
    return O.coalesce_ranges(_ranges(s, d), 1 << 16)


_ISLANDS = f"""r as ({_RANGES}), i as (select off, off + len as e, max(off + len) over (order by off, off + len rows between unbounded preceding and 1 preceding) as b from r),
j as (select off, e, sum(case when b >= off then 0 else 1 end) over (order by off, e rows unbounded preceding) as g from i), islands as (select min(off) as off, max(e) - min(off) as len from j group by g)"""


def range_lookup(s: SparkSession, d: str) -> DataFrame:
    asks = table(s, d, "orders").select((F.col("o_orderkey") * 41 + 3).alias("x")).distinct()
    return O.locate(asks, O.coalesce_ranges(_ranges(s, d), 1 << 16), 1 << 12)


def chunk_split(s: SparkSession, d: str) -> DataFrame:
    return O.chunk(O.store(table(s, d, "pages"), "html"), 400).select("hash", "place", F.md5("chunk").alias("chunk"))


def chunk_reassemble(s: SparkSession, d: str) -> DataFrame:
    whole = O.assemble(O.chunk(O.store(table(s, d, "pages"), "html"), 400, pad=True))
    return whole.select("hash", F.length("value").alias("size"), "intact")


def inode_buckets(s: SparkSession, d: str) -> DataFrame:
    steps = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("step"))
    return steps.groupBy(O.bucket(F.col("step"), 0).alias("top"), O.bucket(F.col("step"), 1).alias("next")).agg(F.count("*").alias("n"))


def slice_export(s: SparkSession, d: str) -> DataFrame:
    """Leaves and directories under the commits that changed an order in the last year."""
    rows = table(s, d, "orders").where("year(o_orderdate) >= 1998").select(F.col("o_orderkey").alias("key"))
    kept = geo(s, d).join(rows, "key", "left_semi")
    dirs = kept.select(F.explode(paths.prefixes(F.col("path"))).alias("path")).distinct().select("path", F.lit("node").alias("kind"))
    return shown(kept.select("path", F.lit("contents").alias("kind")).unionByName(dirs))


def path_functions(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("//"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"))
    p = paths.parse(text)
    return table(s, d, "part").select("p_partkey", paths.show(p).alias("path"), paths.show(paths.parent(p)).alias("parent"), paths.last(p).alias("last"), paths.show(paths.rest(p)).alias("rest"), paths.show(paths.cons(F.lit("x"), paths.rcons(p, F.lit("y")))).alias("more"), F.size(p).alias("size"))


def hash_family(s: SparkSession, d: str) -> DataFrame:
    v = F.col("c_name")
    return table(s, d, "customer").select("c_custkey", hashes.contents(v).alias("contents"), hashes.contents(v, False).alias("contents_v2"), hashes.digest(v, "sha256").alias("sha256"), hashes.short(F.sha1(v)).alias("short"))


def hash_blake(s: SparkSession, d: str) -> DataFrame:
    v = F.col("c_name")
    return table(s, d, "customer").select("c_custkey", hashes.digest(v, "blake2b").alias("blake2b"), hashes.digest(v, "blake2s").alias("blake2s"), hashes.digest(v, "sha512").alias("sha512"))


def log_dates(s: SparkSession, d: str) -> DataFrame:
    who = F.concat(F.col("c_name"), F.lit(" <"), F.col("c_custkey").cast("string"), F.lit("@example.org>"))
    return table(s, d, "customer").select("c_custkey", paths.log_date(F.col("c_custkey") * 86400).alias("date"), paths.author_name(who).alias("name"), paths.author_mail(who).alias("mail"))


_SWAP = " || ".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8))
QUERIES = {
    "commit_history": (commit_history, f"with recursive {COMMITS}, {_WALK.format(n=12)} select commit, level from found"),
    "commit_history_edges": (commit_history_edges, f"with recursive {COMMITS}, {_WALK.format(n=8)} select parent, commit from commits where commit in (select commit from found) and parent in (select commit from found)"),
    "commit_closure": (commit_closure, f"with recursive {COMMITS}, walk as (select max(commit) as commit, 0 as level from numbered union select parent, 0 from walk join commits using (commit) where parent is not null and commit % 50 <> 0) select distinct commit from walk"),
    "lcas_pairs": (lcas_pairs, f"with recursive {COMMITS}, pairs as (select distinct commit as a, commit * 2 // 3 as b from commits where commit % 100 = 7), {_ANC} select a, b, lca from lca"),
    "fast_forward": (fast_forward, f"with recursive {COMMITS}, moves as (select distinct case when commit > 1 then commit end as head, least(commit + commit % 3 * 20, (select max(commit) from commits)) as target from commits where commit % 100 = 1), pairs as (select head as a, target as b from moves where head is not null), {_ANC} {_MOVED}"),
    "commit_history_all": (commit_history_all, f"with recursive {COMMITS}, {_WALK.format(n=1000000)} select commit, level from found"),
    "lcas_pairs_all": (lcas_pairs_all, f"with recursive {COMMITS}, pairs as (select distinct commit as a, (select max(commit) from commits) + 1 - commit as b from commits where commit % 50 = 0), {_ANC} select a, b, lca from lca"),
    "fast_forward_all": (fast_forward_all, f"with recursive {COMMITS}, pairs as (select distinct commit as a, (select max(commit) from commits) + 1 - commit as b from commits where commit % 50 = 0), moves as (select a as head, b as target from pairs), {_ANC} {_MOVED}"),
    "graph_ends": (graph_ends, f"with {COMMITS}, e as (select commit as src, parent as dst from commits where commit % 100 <> 0) select src as node, 'max' as place from e where src not in (select dst from e where dst is not null) group by src union select dst, 'min' from e where dst is not null and dst not in (select src from e where dst is not null)"),
    "heads": (heads, "select event_type as branch, max(event_id) as head, count(*) as commits from events group by event_type"),
    "last_modified": (last_modified, LAST),
    "cas_dedup": (cas_dedup, "select distinct sha1('B' || text) as hash, length(text) as size from documents where text is not null"),
    "cas_verify": (cas_verify, "select doc_id, sha1('B' || text) as hash, case when sha1('B' || text) < 'e' then sha1('B' || text) >= '1' end as intact from documents"),
    "integrity_check": (integrity_check, "with h as (select distinct sha1('B' || text) as hash from documents) select count(*) as entries, count(*) filter (hash < '1') as corrupted from h"),
    "index_check": (index_check, "with a as (select sha1(cast(doc_id as varchar)) as hash, doc_id * 10 as o from documents), b as (select sha1(cast(doc_id + case when doc_id % 31 = 0 then 1000000 else 0 end as varchar)) as hash, doc_id * 10 + case when doc_id % 17 = 0 then 5 else 0 end as o from documents where doc_id % 9 <> 0) select hash, case when b.o is null then 'missing' when a.o is null then 'unknown' else 'elsewhere' end as problem from a full outer join b using (hash) where a.o is distinct from b.o"),
    "traversal_stats": (traversal_stats, "with o as (select 'contents' as kind, text as v from documents union all select 'node', cast(o_custkey as varchar) from orders join customer on o_custkey = c_custkey) select kind, count(*) as entries, count(distinct v) as distinct_entries, count(*) - count(distinct v) as duplicates from o group by kind"),
    "slice_import": (slice_import, "select distinct sha1('B' || text) as hash from documents where doc_id % 2 = 1 and text not in (select text from documents where doc_id % 2 = 0)"),
    "gc_live": (gc_live, "with g as (select o_orderkey as key, c_custkey as c from orders join customer on o_custkey = c_custkey), l as (select distinct c from g where key % 90 in (60, 61)) select 0 as level, 2 as live union all select 1, count(*) from l union all select 2, count(*) from g where c in (select c from l)"),
    "gc_live_all": (gc_live_all, "with g as (select o_orderkey as key, c_custkey as c from orders join customer on o_custkey = c_custkey), l as (select distinct c from g where key % 90 >= 60) select 0 as level, 30 as live union all select 1, count(*) from l union all select 2, count(*) from g where c in (select c from l)"),
    "gc_ranges": (gc_ranges, f"with {_ISLANDS} select off, len from islands"),
    "range_lookup": (range_lookup, f"with {_ISLANDS}, q as (select distinct o_orderkey * 41 + 3 as x from orders), n as (select x, (select min(off) from islands where off + len - 1 >= x) as off from q) select x, off, case when off is null then 'after' when x >= off then 'inside' else 'before' end as place from n"),
    "chunk_split": (chunk_split, "with v as (select distinct html from pages) select sha1('B' || html) as hash, place, md5(substr(html, place * 400 + 1, 400)) as chunk from (select html, unnest(range(0, greatest(cast(ceil(length(html) / 400.0) as bigint), 1))) as place from v)"),
    "chunk_reassemble": (chunk_reassemble, "select distinct sha1('B' || html) as hash, length(html) as size, true as intact from pages"),
    "inode_buckets": (inode_buckets, "select h // 32 as top, h % 32 as next, count(*) as n from (select cast('0x' || substr(sha1(cast(o_orderkey as varchar)), 1, 3) as bigint) // 4 as h from orders) group by all"),
    "slice_export": (slice_export, "with g as (select r_name as a, n_name as b, c_custkey as c, o_orderkey as k from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where year(o_orderdate) >= 1998) select '/' || a || '/' || b || '/' || c || '/' || k as path, 'contents' as kind from g union select '/' || a || '/' || b || '/' || c, 'node' from g union select '/' || a || '/' || b, 'node' from g union select '/' || a, 'node' from g union select '/', 'node' from g"),
    "path_functions": (path_functions, "select p_partkey, '/' || p_brand || '/' || p_type || '/' || p_partkey as path, '/' || p_brand || '/' || p_type as parent, cast(p_partkey as varchar) as last, '/' || p_type || '/' || p_partkey as rest, '/x/' || p_brand || '/' || p_type || '/' || p_partkey || '/y' as more, 3 as size from part"),
    "hash_family": (hash_family, f"with h as (select c_custkey, c_name, sha1(c_name) as h from customer), s as (select *, {_SWAP} as w from h) select c_custkey, sha1('B' || c_name) as contents, h as contents_v2, sha256(c_name) as sha256, cast(('0x' || substr(w, 9, 8))::bigint as hugeint) + ((('0x' || substr(w, 1, 8))::bigint % 2147483648) - case when ('0x' || substr(w, 1, 8))::bigint % 2147483648 >= 1073741824 then 2147483648 else 0 end)::hugeint * 4294967296 as short from s"),
    "hash_blake": (hash_blake, None),
    "log_dates": (log_dates, "select c_custkey, strftime(epoch_ms(c_custkey * 86400000), '%a %b %d %H:%M:%S %Y') as date, c_name as name, c_custkey || '@example.org' as mail from customer"),
}
