"""Queries over the events as an operation trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trace as T
from .derive import TRACE, table, trace

BLOCKS = f"{TRACE}, blocks as (select *, count(*) filter (op = 'Commit') over (order by row_idx) - (op = 'Commit')::int as block from trace)"


def trace_blocks(s: SparkSession, d: str) -> DataFrame:
    return T.blocks(trace(s, d)).groupBy("block").agg(F.count("*").alias("ops"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))


def span_summary(s: SparkSession, d: str) -> DataFrame:
    return T.spans(trace(s, d)).select("block", "span", "n", F.round("duration", 4).alias("duration"), "total_n", F.round("total_duration", 3).alias("total_duration"))


def bag_diffs(s: SparkSession, d: str) -> DataFrame:
    return T.changes(trace(s, d).where("op = 'Commit'"), "row_idx", "duration").select("row_idx", "duration", "before", F.round("change", 4).alias("change"))


def ema_evolution(s: SparkSession, d: str) -> DataFrame:
    return T.ema(trace(s, d), "row_idx", "duration", 0.5, ("op",)).select("op", "row_idx", F.round("ema", 6).alias("ema"))


def ema_evolution_all(s: SparkSession, d: str) -> DataFrame:
    """A slower average, with a half-life of twenty rows."""
    return T.ema(trace(s, d), "row_idx", "duration", T.momentum(20.0), ("op",)).select("op", "row_idx", F.round("ema", 5).alias("ema"))


def ema_relevant(s: SparkSession, d: str) -> DataFrame:
    """One slow average over the whole trace, null until it is relevant."""
    return T.ema(trace(s, d), "row_idx", "duration", T.momentum(100.0), (), 0.01).select("row_idx", F.round("ema", 5).alias("ema"))


def resample_linear(s: SparkSession, d: str) -> DataFrame:
    return T.resample(trace(s, d), "row_idx", "duration", 201).select("place", F.round("value", 6).alias("value"))


def resample_next(s: SparkSession, d: str) -> DataFrame:
    return T.resample(trace(s, d), "row_idx", "duration", 201, "next_neighbour")


def variable_summary(s: SparkSession, d: str) -> DataFrame:
    return T.summary(trace(s, d), "row_idx", "duration", ("op",)).withColumns({"mean": F.round("mean", 6), "change": F.round("change", 4)})


def duration_histogram(s: SparkSession, d: str) -> DataFrame:
    return T.histogram(trace(s, d), "duration", 16, ("op",))


def weekly_share(s: SparkSession, d: str) -> DataFrame:
    """Events of ranges of blocks, from events by week and two hundred blocks a week."""
    e = table(s, d, "events")
    weeks = e.groupBy(F.floor(F.col("event_id") / 1000).alias("period")).agg(F.count("*").cast("double").alias("amount")).withColumn("blocks", F.lit(200) + F.col("period"))
    asked = s.range(20).select(F.col("id").alias("ask"), (F.col("id") * 150).alias("lo"), (F.col("id") * 150 + 400).alias("hi"))
    return T.shares(weeks, asked).select("ask", F.round("amount", 4).alias("amount"))


def path_flatten(s: SparkSession, d: str) -> DataFrame:
    h = F.sha1(F.col("event_id").cast("string"))
    path = F.concat(F.lit("/data/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), F.substring(h, 5, 2), F.lit("/"), F.substring(h, 7, 8), F.lit("/key"))
    return table(s, d, "events").select("event_id", T.flatten_hashes(path).alias("path"))


def elapsed(s: SparkSession, d: str) -> DataFrame:
    """Time since the first operation, and duration so far, at the end of each block."""
    rows = T.running(T.blocks(trace(s, d)), "row_idx", F.col("duration"), "spent")
    return rows.where("op = 'Commit'").select("block", "row_idx", F.round("spent", 3).alias("spent"))


def ema_batches(s: SparkSession, d: str) -> DataFrame:
    """Averages by operation in which a row counts as many values as its number says; every
    thirteenth only lets the past fade."""
    rows = trace(s, d).withColumn("n", F.col("row_idx") % 3 + 1).withColumn("gone", F.col("row_idx") % 13 == 0)
    return T.ema_batches(rows, "row_idx", "duration", "n", 0.5, ("op",), "gone").select("op", "row_idx", F.round("ema", 6).alias("ema"))


EMA_BATCHES = f"""with {TRACE}, r as (select op, row_idx, row_idx % 13 = 0 as gone, row_idx % 3 + 1 as n, duration, sum(row_idx % 3 + 1) over (partition by op order by row_idx) as upto from trace),
p as (select a.op, a.row_idx, sum(case when b.gone then 0 else b.duration * (1 - pow(0.5, b.n)) * pow(0.5, a.upto - b.upto) end) as h, sum(case when b.gone then 0 else (1 - pow(0.5, b.n)) * pow(0.5, a.upto - b.upto) end) as w
  from r a join r b on a.op = b.op and b.upto <= a.upto group by a.op, a.row_idx)
select op, row_idx, case when w > 0 then round(h / w, 6) end as ema from p"""


def evolution(s: SparkSession, d: str) -> DataFrame:
    """The course of durations over blocks, 201 points; commits themselves give no sample."""
    rows = T.blocks(trace(s, d)).withColumn("sample", F.when(F.col("op") != "Commit", F.col("duration") + 1))
    return T.evolution(rows, "block", "sample").select("place", F.round("value", 6).alias("value"))


def evolution_log(s: SparkSession, d: str) -> DataFrame:
    rows = T.blocks(trace(s, d)).withColumn("sample", F.when(F.col("op") == "purchase", F.col("duration") + 1))
    return T.evolution(rows, "block", "sample", 101, log_scale=True).select("place", F.round("value", 6).alias("value"))


_COURSE = """q as (select block, x, count(x) over (order by block) as g from per), f as (select block, max(x) over (partition by g) as x from q), n as (select count(*) as n from f)
select range as place, round({out}, 6) as value from range({points}), n, f where block = cast(ceil(round(range * (n - 1) / {last}, 9)) as bigint)"""


def evolution_smooth(s: SparkSession, d: str) -> DataFrame:
    rows = T.blocks(trace(s, d)).withColumn("sample", F.when(F.col("op") != "Commit", F.col("duration")))
    return T.evolution(rows, "block", "sample", 101, half_life=0.05).select("place", F.round("value", 5).alias("value"))


def bag_phases(s: SparkSession, d: str) -> DataFrame:
    """Two statistics of a store at each commit: rows so far, and durations so far."""
    rows = T.running(trace(s, d), "row_idx", F.col("duration"), "spent").where("op = 'Commit'")
    pair = lambda less: F.array((F.col("row_idx") - less).cast("double"), F.round(F.col("spent") - (F.col("duration") if less else F.lit(0.0)), 3))
    return T.bag_stats(rows.select("row_idx", pair(3).alias("before"), pair(0).alias("after")), "row_idx", ["rows", "spent"]).withColumns({"value": F.round("value", 3), "change": F.round("change", 3)})


def watched_nodes(s: SparkSession, d: str) -> DataFrame:
    """How many rows of three operations there were at each commit, and since the last."""
    kinds = ["click", "view", "purchase"]
    rows = trace(s, d)
    for i, kind in enumerate(kinds):
        rows = T.running(rows, "row_idx", (F.col("op") == kind).cast("long"), f"n{i}")
    return T.watched(rows.where("op = 'Commit'").select("row_idx", F.array("n0", "n1", "n2").alias("lengths")), "row_idx", kinds)


def truncated_spans(s: SparkSession, d: str) -> DataFrame:
    """Counts by operation in the first hundred blocks."""
    return T.truncated(trace(s, d), 100).groupBy("op").agg(F.count("*").alias("n"), F.max("block").alias("last"))


def cpu_usage(s: SparkSession, d: str) -> DataFrame:
    """Durations so far as a CPU clock, row numbers as a wall clock, at commits."""
    rows = T.running(trace(s, d), "row_idx", F.col("duration"), "cpu").where("op = 'Commit'")
    return T.cpu_usage(rows.withColumn("wall", F.col("row_idx").cast("double")), "row_idx", "wall", "cpu").withColumn("usage", F.round("usage", 5))


def heap_top(s: SparkSession, d: str) -> DataFrame:
    return T.heap_top(trace(s, d), "row_idx", "duration").select("row_idx", "top")


def compare_runs(s: SparkSession, d: str) -> DataFrame:
    """Rows by operation in two halves of the trace, and the second's share of the first."""
    per = trace(s, d).groupBy("op", F.when(F.col("row_idx") % 2 == 0, "even").otherwise("odd").alias("run")).agg(F.count("*").cast("double").alias("n"))
    return T.compare(per, "run", ["even", "odd"], "even", "n", ("op",)).withColumn("odd_pct", F.round("odd_pct", 6))


def printed_numbers(s: SparkSession, d: str) -> DataFrame:
    rows = trace(s, d)
    return rows.select("row_idx", T.percent((F.col("row_idx") + 0.3) / 1000).alias("share"), T.duration(F.col("row_idx") / 5).alias("time"), T.snapped(F.col("row_idx") / 5, 1).alias("snapped"))


def summary_json(s: SparkSession, d: str) -> DataFrame:
    per = trace(s, d).groupBy("op").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    return T.as_json(per, "op")


QUERIES = {
    "trace_blocks": (trace_blocks, f"with {BLOCKS} select block, count(*) as ops, min(row_idx) as first, max(row_idx) as last from blocks group by block"),
    "span_summary": (span_summary, f"with {BLOCKS}, per as (select block, span, count(*) as n, sum(duration) as duration from (select block, duration, unnest(case when op = 'Commit' then ['Commit', 'Block'] else [op, 'Buildup', 'Block'] end) as span from blocks) group by all) select block, span, n, round(duration, 4) as duration, sum(n) over w as total_n, round(sum(duration) over w, 3) as total_duration from per window w as (partition by span order by block)"),
    "bag_diffs": (bag_diffs, f"with {TRACE} select row_idx, duration, lag(duration) over (order by row_idx) as before, round(duration - lag(duration) over (order by row_idx), 4) as change from trace where op = 'Commit'"),
    "ema_evolution": (ema_evolution, f"with {TRACE}, r as (select op, row_idx, duration, row_number() over (partition by op order by row_idx) as n from trace) select a.op, a.row_idx, round(sum(b.duration * pow(0.5, a.n - b.n) * 0.5) / (1 - pow(0.5, a.n)), 6) as ema from r a join r b on a.op = b.op and b.n <= a.n group by a.op, a.row_idx, a.n"),
    "ema_evolution_all": (ema_evolution_all, f"with {TRACE}, m as (select exp(ln(0.5) / 20) as m), r as (select op, row_idx, duration, row_number() over (partition by op order by row_idx) as n from trace) select a.op, a.row_idx, round(sum(b.duration * pow(m, a.n - b.n) * (1 - m)) / (1 - pow(m, a.n)), 5) as ema from r a join r b on a.op = b.op and b.n <= a.n, m group by a.op, a.row_idx, a.n, m"),
    "ema_relevant": (ema_relevant, f"with {TRACE}, m as (select exp(ln(0.5) / 100) as m), r as (select row_idx, duration, row_number() over (order by row_idx) as n from trace) select a.row_idx, case when pow(m, a.n) < 0.01 then round(sum(b.duration * pow(m, a.n - b.n) * (1 - m)) / (1 - pow(m, a.n)), 5) end as ema from r a join r b on b.n <= a.n, m group by a.row_idx, a.n, m"),
    "resample_linear": (resample_linear, f"with {TRACE}, n as (select count(*) as n from trace), p as (select range as place, range * (n - 1) / 200.0 as pos from range(201), n), q as (select place, pos, cast(floor(round(pos, 9)) as bigint) as lo, cast(ceil(round(pos, 9)) as bigint) as hi from p) select place, round(a.duration + (b.duration - a.duration) * (round(pos, 9) - lo), 6) as value from q join trace a on a.row_idx = lo join trace b on b.row_idx = hi"),
    "resample_next": (resample_next, f"with {TRACE}, n as (select count(*) as n from trace) select range as place, duration as value from range(201), n, trace where row_idx = cast(ceil(round(range * (n - 1) / 200.0, 9)) as bigint)"),
    "variable_summary": (variable_summary, f"with {TRACE} select op, count(*) as n, max(duration) as most, (select min(row_idx) from trace u where u.op = t.op and u.duration = max(t.duration)) as most_at, min(duration) as least, (select min(row_idx) from trace u where u.op = t.op and u.duration = min(t.duration)) as least_at, round(avg(duration), 6) as mean, round(arg_max(duration, row_idx) - arg_min(duration, row_idx), 4) as change from trace t group by op"),
    "duration_histogram": (duration_histogram, f"with {TRACE}, e as (select op, min(duration) as lo, max(duration) as hi from trace group by op) select op, cast(case when hi = lo then 0 else least(floor((duration - lo) / (hi - lo) * 16), 15) end as bigint) as bin, count(*) as n from trace join e using (op) group by all"),
    "weekly_share": (weekly_share, "with w as (select event_id // 1000 as period, count(*) as amount, 200 + event_id // 1000 as blocks from events group by all), p as (select *, sum(blocks) over (order by period) as e from w), a as (select range as ask, range * 150 as lo, range * 150 + 400 as hi from range(20)), r as (select sum(amount) / sum(blocks) as rate from (select * from w order by period desc limit 3)), l as (select max(e) as last from p), k as (select ask, sum(amount * (least(hi, e) - greatest(lo, e - blocks)) / blocks) as known from a join p on lo < e and e - blocks < hi group by ask) select ask, round(coalesce(known, 0) + greatest(hi - greatest(lo, last), 0) * rate, 4) as amount from a left join k using (ask), r, l"),
    "path_flatten": (path_flatten, "select event_id, '/data/' || substr(sha1(cast(event_id as varchar)), 1, 14) || '/key' as path from events"),
    "elapsed": (elapsed, f"with {BLOCKS}, s as (select *, sum(duration) over (order by row_idx) as spent from blocks) select block, row_idx, round(spent, 3) as spent from s where op = 'Commit'"),
    "ema_batches": (ema_batches, EMA_BATCHES),
    "evolution": (evolution, f"with {BLOCKS}, per as (select block, avg(case when op <> 'Commit' then duration + 1 end) as x from blocks group by block), " + _COURSE.format(out="x", points=201, last="200.0")),
    "evolution_log": (evolution_log, f"with {BLOCKS}, per as (select block, avg(case when op = 'purchase' then ln(duration + 1) end) as x from blocks group by block), " + _COURSE.format(out="exp(x)", points=101, last="100.0")),
    "evolution_smooth": (evolution_smooth, f"with {BLOCKS}, per0 as (select block, avg(case when op <> 'Commit' then duration end) as x from blocks group by block), m as (select exp(ln(0.5) / (0.05 * count(*))) as m from per0), per as (select a.block, sum(b.x * (1 - m) * pow(m, a.block - b.block)) / (1 - pow(any_value(m), a.block + 1)) as x from per0 a join per0 b on b.block <= a.block, m group by a.block), " + _COURSE.format(out="x", points=101, last="100.0").replace(", 6)", ", 5)", 1)),
    "bag_phases": (bag_phases, f"with {BLOCKS}, s as (select *, sum(duration) over (order by row_idx) as spent from blocks), c as (select row_idx, duration, spent from s where op = 'Commit'), v as (select row_idx, 'rows' as name, row_idx - 3.0 as b, cast(row_idx as double) as a from c union all select row_idx, 'spent', round(spent - duration, 3), round(spent, 3) from c), w as (select *, lag(a) over (partition by name order by row_idx) as before from v) select row_idx, name, 'buildup' as phase, round(b, 3) as value, round(b - before, 3) as change from w union all select row_idx, name, 'commit', round(a, 3), round(a - b, 3) from w union all select row_idx, name, 'block', round(a, 3), round(a - before, 3) from w"),
    "watched_nodes": (watched_nodes, f"with {TRACE}, k as (select unnest(['click', 'view', 'purchase']) as name), r as (select row_idx, op, name, count(*) filter (op = name) over (partition by name order by row_idx) as length from trace, k) select row_idx, name, length, length - lag(length) over (partition by name order by row_idx) as change from r where op = 'Commit'"),
    "truncated_spans": (truncated_spans, f"with {BLOCKS} select op, count(*) as n, max(block) as last from blocks where block < 100 group by op"),
    "cpu_usage": (cpu_usage, f"with {BLOCKS}, s as (select row_idx, op, sum(duration) over (order by row_idx) as cpu from blocks), c as (select * from s where op = 'Commit') select row_idx, round((cpu - lag(cpu) over (order by row_idx)) / (row_idx - lag(row_idx) over (order by row_idx)), 5) as usage from c"),
    "heap_top": (heap_top, f"with {TRACE} select row_idx, max(duration) over (order by row_idx) as top from trace"),
    "compare_runs": (compare_runs, f"with {TRACE}, p as (select op, cast(nullif(count(*) filter (row_idx % 2 = 0), 0) as double) as even, cast(nullif(count(*) filter (row_idx % 2 = 1), 0) as double) as odd from trace group by op) select op, even, odd, round(odd / even * 100, 6) as odd_pct from p"),
    "printed_numbers": (printed_numbers, "with t as (select event_id as row_idx, (event_id + 0.3) / 1000 as v, event_id / 5.0 as s, cast(floor(event_id / 5.0 + 0.5) as bigint) as r from events) select row_idx, case when v >= 100 then printf('%.0fx', v) when v * 100 >= 10 then printf('%.0f%%', v * 100) when v * 100 >= 1 then printf('%.1f%%', v * 100) else printf('%.2f%%', v * 100) end as share, case when s < 1 then printf('%.0fms', s * 1000) when s < 60 then printf('%.1fs', s) when r < 3600 then printf('%dm%02ds', r // 60, r % 60) else printf('%dh%02dm', r // 3600, r % 3600 // 60) end as time, s as snapped from t"),
    "summary_json": (summary_json, f"with {TRACE} select op, '{{\"n\":' || count(*) || ',\"first\":' || min(row_idx) || ',\"last\":' || max(row_idx) || '}}' as json from trace group by op"),
}
