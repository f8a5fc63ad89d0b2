"""Queries over the merge algebra and the containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes, merges
from ..operators import containers as C
from ..operators import merge as M
from ..operators import objects as O
from .derive import table

# Ancestor, ours and theirs by customer: equal, changed on one side, on both, deleted, new.
_OLD, _A, _B = (f"case when k % {m} = 0 then null when k % {n} = 0 then 'v' || k % 3 else 'v' || k % 5 end" for m, n in ((7, 2), (5, 2), (3, 4)))
CASES = f"cases as (select c_custkey as k, {_OLD} as o, {_A} as a, {_B} as b, k % 11 <> 0 as known from (select c_custkey, c_custkey as k from customer))"


def _cases(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return rows.select("k", *[F.expr(x).alias(n) for x, n in ((_OLD, "o"), (_A, "a"), (_B, "b"))], (F.col("k") % 11 != 0).alias("known"))


def _merged(merge: merges.Merge):
    def run(s: SparkSession, d: str) -> DataFrame:
        m = merge(*map(F.col, ("known", "o", "a", "b")))
        return _cases(s, d).withColumn("m", m).select("k", "m.ok", "m.value", "m.conflict")

    return run


def _sql(ok: str, value: str, conflict: str) -> str:
    return f"with {CASES}, r as (select *, {ok} as ok from cases) select k, ok, case when ok then {value} end as value, case when not ok then {conflict} end as conflict from r"


_ONE = "case when known and o is not distinct from a then b when known and o is not distinct from b then a else {} end"
_OPTION_OK = """case when known and (o is not distinct from a or o is not distinct from b) then true when a is null and b is null then true
  when a is null or b is null then not known or o is null else a = b end"""


def merge_pair(s: SparkSession, d: str) -> DataFrame:
    """Customer records of a balance class (counter) and a name (idempotent)."""
    merge = merges.struct_of({"n": merges.counter, "v": merges.idempotent})
    rows = _cases(s, d).where("o is not null and a is not null and b is not null")
    side = lambda c, by: F.struct((F.col("k") % by).alias("n"), F.col(c).alias("v"))
    m = merge(F.col("known"), side("o", 3), side("a", 4), side("b", 5))
    return rows.withColumn("m", m).select("k", "m.ok", F.col("m.value.n").alias("n"), F.col("m.value.v").alias("v"), "m.conflict")


PAIR = f"""with {CASES}, r as (
  select k, known, o, a, b, k % 3 as x, k % 4 as y, k % 5 as z, known and (o = a and k % 3 = k % 4) as same_a, known and (o = b and k % 3 = k % 5) as same_b,
    a = b or (known and (o = a or o = b)) as v_ok from cases where o is not null and a is not null and b is not null)
select k, same_a or same_b or v_ok as ok,
  case when same_a then z when same_b then y when v_ok then y + z - case when known then x else 0 end end as n,
  case when same_a then b when same_b then a when v_ok then case when a = b then a when o = a then b else a end end as v,
  case when not (same_a or same_b or v_ok) then 'default' end as conflict from r"""


def _list(s: SparkSession, d: str, column: str) -> DataFrame:
    return _cases(s, d).where(F.col(column).isNotNull()).select("k", F.col(column).alias("v"))


def merge_alist(s: SparkSession, d: str) -> DataFrame:
    return M.keyed(_list(s, d, "o"), _list(s, d, "a"), _list(s, d, "b"), "k", "v", merges.idempotent)


ALIST = f"""with {CASES} select k, case when ok then v end as v, case when not ok then case when a is null or b is null then 'option: add/del' else 'default' end end as conflict from (
  select *, case when o is not distinct from a or o is not distinct from b then true when a is null or b is null then o is null else a = b end as ok,
    case when o is not distinct from a then b when o is not distinct from b then a else coalesce(a, b) end as v
  from cases where a is not null or b is not null) where not ok or v is not null"""


def merge_set(s: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.array_sort(F.collect_set(c))
    rows = _cases(s, d).groupBy((F.col("k") % 50).alias("g")).agg(of("o").alias("o"), of("a").alias("a"), of("b").alias("b"))
    return rows.select("g", F.array_join(merges.sets(F.col("o"), F.col("a"), F.col("b")), ",").alias("merged"))


SET = f"""with {CASES}, m as (select k % 50 as g, 'o' as side, o as v from cases where o is not null union select k % 50, 'a', a from cases where a is not null union select k % 50, 'b', b from cases where b is not null),
p as (select g, v, bool_or(side = 'o') as o, bool_or(side = 'a') as a, bool_or(side = 'b') as b from m group by all)
select g, coalesce(string_agg(v, ',' order by v) filter ((not o and (a or b)) or (a and b)), '') as merged from p group by g"""


def merge_multiset(s: SparkSession, d: str) -> DataFrame:
    count = lambda c: _cases(s, d).where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
    return M.multiset(count("o"), count("a"), count("b"), "v")


def merge_counter(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    m = merges.counter(k % 3 != 0, k, k * 2, k * 3)
    return _cases(s, d).select("k", m["value"].alias("value"))


def merge_seq(s: SparkSession, d: str) -> DataFrame:
    """Default first, then the greater value wins, but never over absence."""
    either = lambda known, o, a, b: F.when(a.isNotNull() & b.isNotNull(), merges.done(F.greatest(a, b))).otherwise(merges.fails(a, "absent"))
    m = merges.with_conflict(merges.first_of(merges.default, either), lambda c: F.concat(F.lit("seq: "), c))(*map(F.col, ("known", "o", "a", "b")))
    return _cases(s, d).withColumn("m", m).select("k", "m.ok", "m.value", "m.conflict")


def merge_like(s: SparkSession, d: str) -> DataFrame:
    """Counters written as text, merged as numbers."""
    merge = merges.like(merges.counter, lambda c: c.cast("long"), lambda c: c.cast("string"))
    k = F.col("k")
    m = merge(F.lit(True), (k % 3).cast("string"), (k % 4).cast("string"), (k % 5).cast("string"))
    return _cases(s, d).withColumn("m", m).select("k", "m.ok", "m.value", "m.conflict")


def _writes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.concat_ws("/", F.lit(""), F.col("user_id").cast("string"), F.col("event_type")).alias("path"), F.col("event_id").alias("ts"), F.round(F.col("value"), 2).alias("v"))


def counter_total(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("event_id") % 7).alias("n"))
    return C.counters(rows, "event_type", "n")


def lww_register(s: SparkSession, d: str) -> DataFrame:
    return C.registers(_writes(s, d), "path", "ts", "v").withColumnRenamed("value", "v")


def _logs(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """The first two turns of a conversation, then odd and even turns on two branches."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.md5("text").alias("message")).where("conv_id is not null and turn is not null").distinct()
    later = c.where("turn >= 2")
    return c.where("turn < 2"), later.where("turn % 2 = 1"), later.where("turn % 2 = 0")


def blob_log_merge(s: SparkSession, d: str) -> DataFrame:
    return C.merge_logs(*_logs(s, d), "conv_id", "turn")


def linked_log_read(s: SparkSession, d: str) -> DataFrame:
    """The two entries of each log before its third turn."""
    old, a, b = _logs(s, d)
    every = old.unionByName(a).unionByName(b)
    cursors = every.select("conv_id").distinct().withColumn("cursor", F.lit(3))
    return C.read_log(every, "conv_id", "turn", cursors, 2)


LOGS = "log as (select distinct conv_id, turn, md5(text) as message from conversations where conv_id is not null and turn is not null)"

def merge_map(s: SparkSession, d: str) -> DataFrame:
    """Maps without an ancestor: a key of both sides agrees only if it is the same."""
    return M.keyed(None, _list(s, d, "a"), _list(s, d, "b"), "k", "v", merges.idempotent, absent_known=False)


def merge_by_key(s: SparkSession, d: str) -> DataFrame:
    """Contents that are known by their hashes, with a store of all values."""
    side = lambda c: _list(s, d, c).select(F.col("k").alias("id"), hashes.contents(F.col("v")).alias("hash"))
    values = O.store(_list(s, d, "o").unionByName(_list(s, d, "a")).unionByName(_list(s, d, "b")).withColumnRenamed("v", "value"))
    return M.by_key(side("o"), side("a"), side("b"), values).withColumnRenamed("id", "k").select("k", "hash", "conflict")


def merge_counter_wraps(s: SparkSession, d: str) -> DataFrame:
    """Counters near the ends of 64 bits."""
    k = F.col("k").cast("long")
    most = F.lit(2**63 - 1).cast("long")
    m = merges.counter(F.lit(True), F.lit(0).cast("long"), most - k, k * 2)
    return _cases(s, d).select("k", m["value"].alias("value"))


def linked_log(s: SparkSession, d: str) -> DataFrame:
    """Logs of conversations that two branches went on with, odd turns and even turns, and
    that a merge joined again: every entry once."""
    c = table(s, d, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", F.md5("text").alias("message")).groupBy("conv_id", "turn").agg(F.min("message").alias("message"))
    side = F.when(F.col("turn") < 2, 0).otherwise(1 + F.col("turn") % 2)
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    w = Window.partitionBy("conv_id", "side").orderBy("turn")
    fork = c.where("turn < 2").groupBy("conv_id").agg(F.max("turn").alias("fork"))
    rows = c.withColumn("side", side).withColumn("prior", F.lag("turn").over(w)).join(fork, "conv_id", "left")
    prior = F.coalesce(F.col("prior"), F.when(F.col("side") > 0, F.col("fork")))
    links = rows.select(name("turn").alias("node"), F.when(prior.isNotNull(), F.array(name(prior))).otherwise(F.array().cast("array<string>")).alias("before"), F.col("turn").alias("ts"), "message", "conv_id")
    ends = rows.groupBy("conv_id", "side").agg(F.max("turn").alias("turn")).select("conv_id", name("turn").alias("node"))
    joined = ends.groupBy("conv_id").agg(F.collect_set("node").alias("before")).select(F.concat_ws("-", "conv_id", F.lit("merge")).alias("node"), "before", F.lit(None).cast(links.schema["ts"].dataType).alias("ts"), F.lit(None).cast("string").alias("message"), "conv_id")
    heads = joined.select(F.col("conv_id").alias("log"), "node")
    return C.linked_log(links.unionByName(joined), heads).select(F.col("log").alias("conv_id"), F.col("ts").alias("turn"), "message", "place")


def log_cursors(s: SparkSession, d: str) -> DataFrame:
    """Where the second page of each log starts, and what is on it."""
    old, a, b = _logs(s, d)
    every = old.unionByName(a).unionByName(b)
    first = C.read_log(every, "conv_id", "turn", n=2)
    return C.read_log(every, "conv_id", "turn", C.next_cursors(first, "conv_id", "turn"), 2)


QUERIES = {
    "merge_default": (_merged(merges.default), _sql("known and (o is not distinct from a or o is not distinct from b)", _ONE.format("null"), "'default'")),
    "merge_idempotent": (_merged(merges.idempotent), _sql("a is not distinct from b or (known and (o is not distinct from a or o is not distinct from b))", f"case when a is not distinct from b then a else {_ONE.format('null')} end", "'default'")),
    "merge_option": (_merged(merges.option(merges.idempotent)), _sql(_OPTION_OK, _ONE.format("coalesce(a, b)"), "case when a is null or b is null then 'option: add/del' else 'default' end")),
    "merge_pair": (merge_pair, PAIR),
    "merge_alist": (merge_alist, ALIST),
    "merge_set": (merge_set, SET),
    "merge_multiset": (merge_multiset, f"with {CASES} select v, sum(n) as n from (select a as v, 1 as n from cases union all select b, 1 from cases union all select o, -1 from cases) where v is not null group by v having sum(n) <> 0"),
    "merge_counter": (merge_counter, f"with {CASES} select k, k * 5 - case when k % 3 <> 0 then k else 0 end as value from cases"),
    "merge_seq": (merge_seq, _sql("(known and (o is not distinct from a or o is not distinct from b)) or (a is not null and b is not null)", _ONE.format("greatest(a, b)"), "'seq: absent'")),
    "merge_like": (merge_like, f"with {CASES} select k, true as ok, case when k % 3 = k % 4 then cast(k % 5 as varchar) when k % 3 = k % 5 then cast(k % 4 as varchar) else cast(k % 4 + k % 5 - k % 3 as varchar) end as value, cast(null as varchar) as conflict from cases"),
    "counter_total": (counter_total, "select event_type, sum(case when event_id % 3 = 0 then -1 else event_id % 7 end) as value from events group by event_type"),
    "lww_register": (lww_register, "select '/' || user_id || '/' || event_type as path, max(event_id) as ts, round(arg_max(value, event_id), 2) as v from events group by all"),
    "blob_log_merge": (blob_log_merge, f"with {LOGS}, old as (select * from log where turn < 2), newest as (select conv_id, max(turn) as m from old group by all), kept as (select * from old union all select l.* from log l left join newest using (conv_id) where turn >= 2 and (m is null or turn > m)) select conv_id, turn, message, row_number() over (partition by conv_id order by turn desc, message desc) as place from kept"),
    "linked_log_read": (linked_log_read, f"with {LOGS} select * from (select conv_id, turn, message, row_number() over (partition by conv_id order by turn desc) as place from log where turn < 3) where place <= 2"),
    "merge_map": (merge_map, f"with {CASES} select k, case when a is null or b is null or a = b then coalesce(a, b) end as v, case when a <> b then 'default' end as conflict from cases where a is not null or b is not null"),
    "merge_by_key": (merge_by_key, f"with m as ({ALIST}) select k, sha1('B' || v) as hash, conflict from m"),
    "merge_counter_wraps": (merge_counter_wraps, f"with {CASES} select k, cast(case when k > 0 then k::hugeint - 9223372036854775809 else 9223372036854775807 end as bigint) as value from cases"),
    "linked_log": (linked_log, "with log as (select conv_id, turn, min(md5(text)) as message from conversations where conv_id is not null and turn is not null group by all) select conv_id, turn, message, row_number() over (partition by conv_id order by turn desc) as place from log"),
    "log_cursors": (log_cursors, f"with {LOGS}, n as (select *, row_number() over (partition by conv_id order by turn desc) as r from log), c as (select conv_id, min(turn) as cursor from n where r <= 2 group by conv_id), p as (select l.*, row_number() over (partition by conv_id order by turn desc) as place from log l join c using (conv_id) where turn < cursor) select conv_id, turn, message, place from p where place <= 2"),
}
