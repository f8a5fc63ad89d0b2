"""Queries over watches, proofs and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import drawing as D
from ..operators import graph as G
from ..operators import json_trees as J
from ..operators import objects as O
from ..operators import proofs as P
from ..operators import trees as T
from ..sources import sync
from ..streaming import watch as W
from .branch_queries import OBJECTS, _objects
from .derive import GEO, geo, shown, table
from .tree_queries import MERKLE


def _heads(s: SparkSession, d: str) -> DataFrame:
    """A branch for each user; every fifth event removes it, others set it by their value."""
    head = F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") / 50).cast("int").cast("string"))
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("branch"), F.col("event_id").alias("seq"), head.alias("head"))


HEADS = "heads as (select cast(user_id as varchar) as branch, event_id as seq, case when event_id % 5 <> 0 then cast(cast(round(value / 50) as int) as varchar) end as head from events)"
EVENTS = f"{HEADS}, ev as (select branch, seq, case when before is null then 'added' when head is null then 'removed' else 'updated' end as kind, before, head as after from (select *, lag(head) over (partition by branch order by seq) as before from heads) where before is distinct from head)"


def watch_events(s: SparkSession, d: str) -> DataFrame:
    return W.replay(_heads(s, d))


def watch_key(s: SparkSession, d: str) -> DataFrame:
    heads = _heads(s, d)
    values = heads.where("head is not null").select("head").distinct().select("head", F.when(F.col("head") != "3", (F.col("head").cast("int") / 2).cast("int").cast("string")).alias("value"))
    return W.watch_key(W.replay(heads), values)


def _keys(s: SparkSession, d: str) -> DataFrame:
    return geo(s, d).where("key % 701 = 0").select("path")


def proof_rows(s: SparkSession, d: str) -> DataFrame:
    return shown(P.prove(geo(s, d), _keys(s, d), 4), "parent").select("parent", "step", "kind", "hash", "value", "blinded")


PROOF = MERKLE[: MERKLE.rindex("select path, hash from l3 union all")] + """, t as (select s1, s2, s3, s4 from geo where key % 701 = 0),
e as (
  select '/' as parent, steps[1] as step, kind, hash, cast(null as varchar) as value, steps[1] in (select s1 from t) as open, true as near from l1
  union all select '/' || steps[1], steps[2], kind, hash, null, (steps[1], steps[2]) in (select (s1, s2) from t), steps[1] in (select s1 from t) from l2
  union all select '/' || steps[1] || '/' || steps[2], steps[3], kind, hash, null, (steps[1], steps[2], steps[3]) in (select (s1, s2, s3) from t), (steps[1], steps[2]) in (select (s1, s2) from t) from l3
  union all select '/' || s1 || '/' || s2 || '/' || s3, s4, 'contents', sha1('B' || value), case when key % 701 = 0 then value end, key % 701 = 0, (s1, s2, s3) in (select (s1, s2, s3) from t) from geo)
select parent, step, kind, hash, value, not open as blinded from e where near"""


def dot_lines(s: SparkSession, d: str) -> DataFrame:
    """The edges of the upper two levels as lines of a graph drawing."""
    n = geo(s, d).select(F.get(F.col("path"), F.lit(0)).alias("a"), F.get(F.col("path"), F.lit(1)).alias("b")).distinct()
    return n.select(F.format_string('"%s" -> "%s";', F.col("a"), F.col("b")).alias("line"))


def json_project(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.to_json(F.struct(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("type")).alias("user"), F.array("event_id").alias("ids"))).alias("doc"))
    return shown(J.project(e, "event_id", "doc"))


def json_merge(s: SparkSession, d: str) -> DataFrame:
    """Objects of three members: numbers, arrays, and one that may be absent, null or true."""
    k = F.col("c_custkey")
    odd = lambda n: F.element_at(F.array(F.lit(""), F.lit(',"c":null'), F.lit(',"c":true'), F.lit(',"c":1')), (k % n + 1).cast("int"))
    doc = lambda n, m, x: F.concat(F.lit('{"a":'), (k % n).cast("string"), F.lit(',"b":['), (k % m).cast("string"), F.lit("]"), odd(x), F.lit("}"))
    return table(s, d, "customer").select(k, J.merge_json(doc(2, 3, 2), doc(3, 3, 3), doc(2, 4, 4)).alias("m")).select("c_custkey", "m.ok", F.when(F.col("m.ok"), F.col("m.value")).alias("value"))


_ODD = "case c_custkey % {n} when 0 then '-' when 1 then 'null' when 2 then 'true' else '1' end"
JSON_MERGE = f"""with k as (select c_custkey, c_custkey % 2 as oa, c_custkey % 3 as aa, c_custkey % 2 as ba, c_custkey % 3 as ob, c_custkey % 3 as ab, c_custkey % 4 as bb,
  {_ODD.format(n=2)} as oc, {_ODD.format(n=3)} as ac, {_ODD.format(n=4)} as bc from customer),
m as (select *, oc = ac or oc = bc or (oc = '-' and (ac = '-' or bc = '-')) or (oc = 'null' and ac = 'null' and bc = 'null') as ok,
  case when oc = ac then bc when oc = bc then ac when oc = '-' then case when ac = '-' then bc else ac end end as c from k),
w as (select *, case when aa = oa then ba else aa end as a, case when ab = ob then bb else ab end as b from m),
same as (select *, (oa = aa and oc = ac and ob = ab) as left_same, (oa = ba and ob = bb and oc = bc) as right_same from w),
r as (select *, ok or left_same or right_same or (oc = '-' and ac = 'null' and bc = 'null') as fine from same)
select c_custkey, fine as ok, case when fine then '{{"a": ' || a || ', "b": [' || b || ']' || case c when '-' then '' else ', "c": ' || c end || '}}' end as value from r"""


def _documents(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", F.to_json(F.struct(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("type")).alias("user"), F.array("event_id").alias("ids"))).alias("doc"))


def json_rebuild(s: SparkSession, d: str) -> DataFrame:
    """Documents out of their leaves."""
    return J.assemble(J.project(_documents(s, d), "event_id", "doc"), "event_id")


def json_get(s: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc")
    return _documents(s, d).select("event_id", J.value_at(doc, ["user", "id"]).alias("id"), J.value_at(doc, ["user"]).alias("user"), J.value_at(doc, ["ids"]).alias("ids"), J.value_at(doc, ["user", "none"]).alias("none"))


def json_set(s: SparkSession, d: str) -> DataFrame:
    """Every third document's user becomes another object, every fifth's a number."""
    docs = _documents(s, d)
    new = docs.where("event_id % 3 = 0 or event_id % 5 = 0").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit('{"a":{"b":1}}')).otherwise(F.lit("7")).alias("doc"))
    return J.assemble(J.put(J.project(docs, "event_id", "doc"), "event_id", ["user"], new, "doc"), "event_id")


def json_equal(s: SparkSession, d: str) -> DataFrame:
    """Texts of one value in other words: keys the other way round and white space."""
    k = F.col("event_id")
    one = F.concat(F.lit('{"a": '), (k % 3).cast("string"), F.lit(', "b":[1, {"x":null}]}'))
    two = F.concat(F.lit('{"b":[1,{"x":null}],"a":'), (k % 4).cast("string"), F.lit("}"))
    return table(s, d, "events").select("event_id", (J.canonical(one) == J.canonical(two)).alias("same"))


def json_deep(s: SparkSession, d: str) -> DataFrame:
    """A document of forty levels has its one leaf."""
    deep = s.range(1).select("id", F.concat(F.repeat(F.lit('{"k":'), 40), F.lit("1"), F.repeat(F.lit("}"), 40)).alias("doc"))
    return J.project(deep, "id", "doc").select("id", F.size("path").alias("depth"), "value")


def head_commits(s: SparkSession, d: str) -> DataFrame:
    """Events of heads as events of commits, of which two are not known."""
    heads = _heads(s, d)
    known = heads.where("head is not null and head not in ('2', '3')").select(F.col("head").alias("hash")).distinct()
    return W.lift(W.replay(heads), known)


def object_dot(s: SparkSession, d: str) -> DataFrame:
    """The drawing of commits over customers, without orders."""
    return D.lines(G.object_edges(*_objects(s, d)), full=False)


def proof_run(s: SparkSession, d: str) -> DataFrame:
    """A change run on the leaves that a proof knows, checked against the whole tree changed."""
    rows, keys = G.settle(geo(s, d)), _keys(s, d)
    proof = G.settle(P.prove(rows, keys, 4))
    before = T.node_hashes(rows).where(F.size("path") == 0).first().hash
    touched = keys.select("path", F.lit(True).alias("touched"))
    whole = rows.select(*T.LEAF).join(touched, "path", "left").withColumn("value", F.when(F.col("touched"), F.lower("value")).otherwise(F.col("value")))
    after = T.node_hashes(whole).where(F.size("path") == 0).first().hash
    return shown(P.run(proof, before, lambda t: t.withColumn("value", F.lower("value")), after))


def info_helpers(s: SparkSession, d: str) -> DataFrame:
    """What commits say of themselves, and the branches that references name."""
    k = F.col("c_custkey")
    said = paths.info(k % 3, F.when(k % 2 == 0, F.lit("")).otherwise(F.col("c_name")), F.lit(""))
    ref = paths.reference(F.concat(F.element_at(F.array(*map(F.lit, ("refs/heads/", "refs/remotes/", "refs/tags/", "none/"))), (k % 4 + 1).cast("int")), F.col("c_name")))
    raw = F.when(k % 2 == 0, F.encode("c_name", "UTF-8")).otherwise(F.unhex(F.lit("ff41")))
    return table(s, d, "customer").select(k, paths.no_info(said).alias("nothing"), ref["kind"].alias("kind"), ref["name"].alias("name"), paths.valid_text(raw).alias("valid"))


def slice_json(s: SparkSession, d: str) -> DataFrame:
    """Contents of a slice through text and back."""
    part = {"contents": O.store(geo(s, d).select(F.concat("metadata", F.lit('"'), "value").alias("value")))}
    return sync.of_json(sync.as_json(part))["contents"]


_SHOWN = "'\"' || {0} || '\"'"
DOT = f"""with {OBJECTS}, e as (select src, dst from edges where dst not like 'contents:%'), o as (select src as x from e union select dst from e)
select 0 as place, 'digraph G {{' as line union all select 3, '}}'
union all select 1, {_SHOWN.format('x')} || ' [shape=' || case split_part(x, ':', 1) when 'branch' then 'cds' when 'commit' then 'box' else 'ellipse' end || '];' from o
union all select 2, {_SHOWN.format('src')} || ' -> ' || {_SHOWN.format('dst')} || ' [style=' || case split_part(dst, ':', 1) when 'commit' then 'bold' else 'solid' end || '];' from e"""

QUERIES = {
    "watch_events": (watch_events, f"with {EVENTS} select * from ev"),
    "watch_key": (watch_key, f"with {EVENTS}, v as (select distinct head, case when head <> '3' then cast(cast(trunc(cast(head as int) / 2.0) as int) as varchar) end as value from heads where head is not null), j as (select branch, seq, o.value as old, n.value as new from ev left join v o on before = o.head left join v n on after = n.head) select branch, seq, case when old is null then 'added' when new is null then 'removed' else 'updated' end as kind, old, new from j where old is distinct from new"),
    "proof_rows": (proof_rows, PROOF),
    "dot_lines": (dot_lines, "select distinct '\"' || r_name || '\" -> \"' || n_name || '\";' as line from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    "json_project": (json_project, "select event_id, '/user/id' as path, cast(user_id as varchar) as value from events union all select event_id, '/user/type', '\"' || event_type || '\"' from events union all select event_id, '/ids', '[' || event_id || ']' from events"),
    "json_merge": (json_merge, JSON_MERGE),
    "json_rebuild": (json_rebuild, "select event_id, '{\"ids\":[' || event_id || '],\"user\":{\"id\":' || user_id || ',\"type\":\"' || event_type || '\"}}' as value from events"),
    "json_get": (json_get, "select event_id, cast(user_id as varchar) as id, '{\"id\":' || user_id || ',\"type\":\"' || event_type || '\"}' as user, '[' || event_id || ']' as ids, cast(null as varchar) as none from events"),
    "json_set": (json_set, "select event_id, '{\"ids\":[' || event_id || '],\"user\":' || case when event_id % 3 = 0 then '{\"a\":{\"b\":1}}' when event_id % 5 = 0 then '7' else '{\"id\":' || user_id || ',\"type\":\"' || event_type || '\"}' end || '}' as value from events"),
    "json_equal": (json_equal, "select event_id, event_id % 3 = event_id % 4 as same from events"),
    "json_deep": (json_deep, "select 0 as id, 40 as depth, '1' as value"),
    "head_commits": (head_commits, f"with {EVENTS}, j as (select branch, seq, case when before not in ('2', '3') then before end as o, case when after not in ('2', '3') then after end as n from ev) select branch, seq, case when o is null then 'added' when n is null then 'removed' else 'updated' end as kind, o as before, n as after from j where o is not null or n is not null"),
    "object_dot": (object_dot, DOT),
    "proof_run": (proof_run, f"with {GEO} select path, lower(value) as value, metadata from geo where key % 701 = 0"),
    "info_helpers": (info_helpers, "select c_custkey, c_custkey % 3 = 0 and c_custkey % 2 = 0 as nothing, case c_custkey % 4 when 0 then 'branch' when 1 then 'remote' when 2 then 'tag' end as kind, case when c_custkey % 4 < 3 then c_name end as name, c_custkey % 2 = 0 as valid from customer"),
    "slice_json": (slice_json, "select distinct sha1('B' || o_orderpriority || '\"' || o_orderstatus) as hash, o_orderpriority || '\"' || o_orderstatus as value from orders join customer on o_custkey = c_custkey"),
}
