"""Trace analytics: running numbers, moving averages, resampling and summaries."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SLAB = 1 << 16  # of the order column; a running number is built from slabs


def running(df: DataFrame, order: str, value: Column, out: str, by: tuple[str, ...] = (), slab: int = SLAB) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows before and at each row in the
    order of a whole-number column, apart for each ``by``.

    Rows are summed inside slabs of the order, one window each, and the slabs' totals are
    summed over the slabs, so neither a long series nor a frequent key lands in one task.
    """
    rows = df.withColumn("_v", value).withColumn("_slab", F.floor(F.col(order) / slab))
    totals = rows.groupBy(*by, "_slab").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*by, "_slab").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.sum("_v").over(inside)).join(carried, [*by, "_slab"])
    return rows.withColumn(out, F.col("_here") + F.col("_before")).drop("_v", "_slab", "_here", "_before")


def blocks(trace: DataFrame) -> DataFrame:
    """``trace`` (``row_idx, op, duration``) with ``block``, the number of commits before a
    row: a commit belongs to the block that it ends."""
    commit = (F.col("op") == "Commit").cast("long")
    return running(trace, "row_idx", commit, "block").withColumn("block", F.col("block") - commit)


def spans(trace: DataFrame) -> DataFrame:
    """``block, span, n, duration, total_n, total_duration``: for each block the count and
    duration of each kind of operation, of all before the commit (Buildup) and of the whole
    (Block), and the same summed over the blocks so far."""
    rows = blocks(trace)
    whole = F.array(F.col("op"), F.when(F.col("op") != "Commit", F.lit("Buildup")), F.lit("Block"))
    per = rows.select("block", F.explode(F.filter(whole, lambda s: s.isNotNull())).alias("span"), "duration").groupBy("block", "span").agg(F.count("*").alias("n"), F.sum("duration").alias("duration"))
    out = running(per, "block", F.col("n"), "total_n", ("span",))
    return running(out, "block", F.col("duration"), "total_duration", ("span",))


def changes(rows: DataFrame, order: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``before`` and ``change``, against the row before in order (null at the
    first). The row before is found by an equi-join on a running number."""
    numbered = running(rows, order, F.lit(1), "_n", by)
    last = numbered.select(*by, (F.col("_n") + 1).alias("_n"), F.col(value).alias("before"))
    return numbered.join(last, [*by, "_n"], "left").withColumn("change", F.col(value) - F.col("before")).drop("_n")


def momentum(half_life: float, steps: int | None = None) -> float:
    """The momentum that halves a value's weight in ``half_life`` steps, or in that share of
    ``steps``."""
    h = half_life if steps is None else half_life * steps
    return 0.0 if h == 0 else exp(log(0.5) / h)


STRIP = 256  # blocks whose carries are found in one row


def _carries(ends: DataFrame, m: float, by: tuple[str, ...]) -> DataFrame:
    """``by, _b, _carry``: the hidden value that each block (``_b, _end, _size``) starts from.

    h' = h m^size + end is folded over strips of blocks from zero, then over the strips, whose
    fold is of the same kind; what a strip starts from fades by m for each value in between.
    A row holds a strip of blocks, or the strips of one series: 256 x 256 blocks of up to 4096
    values fill one such row once.
    """
    empty = F.expr("cast(array() as array<struct<_b:bigint,_carry:double,_before:bigint>>)")

    def fold(rows: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("h"), F.lit(0).cast("bigint").alias("n"), empty.alias("out"))
        step = lambda s, e: F.struct((s["h"] * F.pow(F.lit(m), e["_size"]) + e["_end"]).alias("h"), (s["n"] + e["_size"]).alias("n"), F.array_append(s["out"], F.struct(e["_b"].alias("_b"), s["h"].alias("_carry"), s["n"].alias("_before"))).alias("out"))
        return F.aggregate(rows, start, step)

    def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(F.col("_b").cast("bigint").alias("_b"), "_end", "_size")))
        return rows.groupBy(*keys).agg(fold(ordered).alias("f"))

    strips = folded(ends.withColumn("_s", F.floor(F.col("_b") / STRIP)), [*by, "_s"])
    over = folded(strips.select(*by, F.col("_s").alias("_b"), F.col("f.h").alias("_end"), F.col("f.n").alias("_size")), list(by))
    starts = over.select(*by, F.inline("f.out")).select(*by, F.col("_b").alias("_s"), F.col("_carry").alias("_start"))
    inside = strips.select(*by, "_s", F.inline("f.out"))
    return inside.join(starts, [*by, "_s"]).select(*by, "_b", (F.col("_carry") + F.col("_start") * F.pow(F.lit(m), "_before")).alias("_carry"))


def ema_batches(batches: DataFrame, order: str, value: str, count: str, m: float, by: tuple[str, ...] = (), forget: str | None = None) -> DataFrame:
    """``batches`` with ``ema``: each row stands for ``count`` equal values at once, so the past
    fades by m^count; where ``forget`` is true it only fades, and nothing comes in. Null while
    nothing has come in."""
    if not 0 <= m < 1:
        raise ValueError("momentum must be at least 0 and less than 1")
    fades = F.pow(F.lit(m), F.col(count))
    gone = F.col(forget) if forget else F.lit(False)
    numbered = running(batches, order, F.lit(1), "_b", by)
    steps = numbered.withColumn("_end", F.when(gone, F.lit(0.0)).otherwise(F.col(value) * (1 - fades))).withColumn("_size", F.col(count).cast("bigint"))
    # What the past weighs at all is the same fold over values of one.
    weights = steps.withColumn("_end", F.when(gone, F.lit(0.0)).otherwise(1 - fades))
    hidden = _carries(steps.select(*by, "_b", "_end", "_size"), m, by).withColumnRenamed("_carry", "_h")
    weight = _carries(weights.select(*by, "_b", "_end", "_size"), m, by).withColumnRenamed("_carry", "_w")
    rows = steps.join(hidden, [*by, "_b"]).join(weight, [*by, "_b"])
    h = F.col("_h") * fades + F.col("_end")
    w = F.col("_w") * fades + F.when(gone, F.lit(0.0)).otherwise(1 - fades)
    return rows.withColumn("ema", F.when(w > 0, h / w)).drop("_b", "_end", "_size", "_h", "_w")


def ema(series: DataFrame, order: str, value: str, m: float, by: tuple[str, ...] = (), relevant: float | None = None) -> DataFrame:
    """``series`` with ``ema``: hidden' = m hidden + (1 - m) x, divided by 1 - m^n after n
    values; with ``relevant``, null while m^n isn't below it.

    Inside blocks whose powers of m stay in range the sum is closed; what a block hands on is
    folded strip by strip.
    """
    if not 0 <= m < 1:
        raise ValueError("momentum must be at least 0 and less than 1")
    if m == 0:
        return series.withColumn("ema", F.col(value).cast("double"))
    size = max(1, min(4096, int(300 / -log(m))))
    rows = running(series, order, F.lit(1), "_n", by).withColumn("_b", F.floor((F.col("_n") - 1) / size)).withColumn("_i", (F.col("_n") - 1) % size)
    inside = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(F.col(value) * F.pow(F.lit(m), -F.col("_i"))).over(inside)
    rows = rows.withColumn("_own", scaled * F.pow(F.lit(m), "_i") * (1 - m))
    ends = rows.groupBy(*by, "_b").agg(F.max_by("_own", "_i").alias("_end"), F.count("*").alias("_size"))
    carries = _carries(ends, m, by)
    hidden = F.col("_own") + F.col("_carry") * F.pow(F.lit(m), F.col("_i") + 1)
    void = F.pow(F.lit(m), F.col("_n"))
    out = hidden / (1 - void)
    if relevant is not None:
        out = F.when(void < relevant, out)
    return rows.join(carries, [*by, "_b"]).withColumn("ema", out).drop("_n", "_b", "_i", "_own", "_carry")


def resample(series: DataFrame, order: str, value: str, size: int, mode: str = "interpolate") -> DataFrame:
    """``place, value``: ``size`` points of a series numbered 0 to n - 1, its ends fixed;
    between points either the line or the next neighbour. Each new point asks for one or two
    old ones, by equi-joins."""
    spark = series.sparkSession
    n = series.agg(F.count("*").alias("n"))
    at = spark.range(size).crossJoin(n).select(F.col("id").alias("place"), F.when(F.lit(size) == 1, F.lit(0.0)).otherwise(F.col("id") * (F.col("n") - 1) / max(size - 1, 1)).alias("at"))
    points = series.select(F.col(order).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    high = at.withColumn("i", F.ceil(F.round("at", 9))).join(points, "i").select("place", "at", F.col("v").alias("high"))
    if mode == "next_neighbour":
        return high.select("place", F.col("high").alias("value"))
    low = at.withColumn("i", F.floor(F.round("at", 9))).join(points, "i").select("place", F.col("v").alias("low"))
    share = F.round(F.col("at"), 9) - F.floor(F.round(F.col("at"), 9))
    return high.join(low, "place").select("place", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("value"))


def summary(rows: DataFrame, order: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """For each ``by``: ``n, most, most_at, least, least_at, mean, change`` (last less first)
    of the values that are numbers. All in one aggregation."""
    v = F.col(value)
    good = rows.where(v.isNotNull() & ~F.isnan(v))
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.max(v).alias("most"), F.max_by(order, F.struct(v, -F.col(order))).alias("most_at"), F.min(v).alias("least"), F.min_by(order, F.struct(v, F.col(order))).alias("least_at"), F.avg(v).alias("mean"), (F.max_by(v, order) - F.min_by(v, order)).alias("change"))


def histogram(rows: DataFrame, value: str, bins: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, bin, n``: counts in equal bins between the least and the greatest value."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    joined = rows.join(ends, list(by)) if by else rows.crossJoin(ends)
    return joined.groupBy(*by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def shares(periods: DataFrame, asked: DataFrame) -> DataFrame:
    """``ask, amount``: what ranges of blocks (``ask, lo, hi``, hi excluded) have of the
    amounts of periods (``period, blocks, amount``, in order), each period giving in
    proportion to the blocks that it shares. Beyond the last period the last three go on.
    """
    w = Window.orderBy("period")
    p = periods.withColumn("end", F.sum("blocks").over(w)).withColumn("start", F.col("end") - F.col("blocks"))
    recent = p.withColumn("r", F.row_number().over(Window.orderBy(F.desc("period")))).where("r <= 3").agg((F.sum("amount") / F.sum("blocks")).alias("rate"), F.max("end").alias("last"))
    overlap = F.least("hi", "end") - F.greatest("lo", "start")
    inside = asked.join(p, (F.col("lo") < F.col("end")) & (F.col("start") < F.col("hi"))).groupBy("ask").agg(F.sum(F.col("amount") * overlap / F.col("blocks")).alias("known"))
    beyond = asked.crossJoin(F.broadcast(recent)).select("ask", (F.greatest(F.col("hi") - F.greatest("lo", "last"), F.lit(0)) * F.col("rate")).alias("more"))
    return beyond.join(inside, "ask", "left").select("ask", (F.coalesce("known", F.lit(0.0)) + F.col("more")).alias("amount"))


def flatten_hashes(path: Column) -> Column:
    """A written path in which a hash chopped into directories of two hex digits is one step
    again."""
    joined = path
    for _ in range(5):
        joined = F.regexp_replace(joined, r"(?<=/)((?:[0-9a-f]{2})+)/((?:[0-9a-f]{2})+)(?=/|$)", "$1$2")
    return joined


def evolution(samples: DataFrame, period: str, value: str, points: int = 201, half_life: float | None = None, relevant: float = 1.0, log_scale: bool = False) -> DataFrame:
    """``place, value``: a variable's course over periods numbered 0 to n - 1, each with any
    number of samples, at ``points`` places.

    A period counts with the mean of its samples that are numbers (of their logarithms on a
    log scale), one without such samples with the period before. ``half_life``, as a share of
    the periods, smooths the course by a moving average before it is resampled; ``relevant``
    leaves it null while the average's first values still weigh as much.
    """
    v = F.log(F.col(value)) if log_scale else F.col(value)
    good = samples.withColumn("_x", F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value)), v)).groupBy(period).agg(F.avg("_x").alias("_x"))
    held = _last_known(good, period, "_x")
    if half_life is not None:
        n = held.count()
        held = ema(held, period, "_x", momentum(half_life, n), (), relevant if relevant < 1 else None).drop("_x").withColumnRenamed("ema", "_x")
    out = resample(held, period, "_x", points, "next_neighbour")
    return out.withColumn("value", F.exp("value")) if log_scale else out


def _last_known(rows: DataFrame, order: str, value: str, slab: int = SLAB) -> DataFrame:
    """``rows`` with nulls of ``value`` filled by the last value before, slab by slab of the
    order, and over the slabs."""
    slabs = rows.withColumn("_slab", F.floor(F.col(order) / slab))
    lasts = slabs.where(F.col(value).isNotNull()).groupBy("_slab").agg(F.max_by(value, order).alias("_last"))
    every = slabs.select("_slab").distinct().join(lasts, "_slab", "left")
    before = Window.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65536 periods
    carried = every.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select("_slab", "_carry")
    inside = Window.partitionBy("_slab").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = slabs.join(carried, "_slab").withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry"))
    return found.drop("_slab", "_carry")


def bag_stats(bags: DataFrame, order: str, names: list[str]) -> DataFrame:
    """For each of ``names`` and each row in order, a row ``order, name, phase, value, change``
    of a statistic that is taken before and after each commit: ``before`` and ``after`` as
    arrays in the order of ``names``. Phases: buildup (from the commit before to this one's
    start), commit (during it) and block (both)."""
    at = F.posexplode(F.arrays_zip(F.col("before").alias("b"), F.col("after").alias("a")))
    rows = bags.select(order, at.alias("_i", "_v")).withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("_i"))).select(order, "name", F.col("_v.b").alias("b"), F.col("_v.a").alias("a"))
    numbered = changes(rows, order, "a", ("name",))
    phases = F.array(
        F.struct(F.lit("buildup").alias("phase"), F.col("b").alias("value"), (F.col("b") - F.col("before")).alias("change")),
        F.struct(F.lit("commit").alias("phase"), F.col("a").alias("value"), (F.col("a") - F.col("b")).alias("change")),
        F.struct(F.lit("block").alias("phase"), F.col("a").alias("value"), F.col("change").alias("change")),
    )
    return numbered.select(order, "name", F.inline(phases))


def watched(lengths: DataFrame, order: str, names: list[str]) -> DataFrame:
    """``order, name, length, change`` of the lengths of watched nodes (an array in the order
    of ``names``) at each commit, and what changed since the commit before."""
    rows = lengths.select(order, F.posexplode("lengths").alias("_i", "length")).withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("_i")))
    return changes(rows.select(order, "name", "length"), order, "length", ("name",)).select(order, "name", "length", "change")


def truncated(trace: DataFrame, count: int) -> DataFrame:
    """The rows of the first ``count`` blocks, with their ``block``."""
    return blocks(trace).where(F.col("block") < count)


def cpu_usage(rows: DataFrame, order: str, wall: str, cpu: str) -> DataFrame:
    """``order, usage``: CPU time by wall time of each row since the row before, both given as
    running clocks; null where no time has passed."""
    w = changes(rows.select(order, wall), order, wall).select(order, F.col("change").alias("_wall"))
    c = changes(rows.select(order, cpu), order, cpu).select(order, F.col("change").alias("_cpu"))
    return w.join(c, order).select(order, F.when(F.col("_wall") > 0, F.col("_cpu") / F.col("_wall")).alias("usage"))


def heap_top(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``rows`` with ``top``, the greatest value so far: slab by slab, and over the slabs."""
    slabs = rows.withColumn("_slab", F.floor(F.col(order) / SLAB))
    tops = slabs.groupBy("_slab").agg(F.max(value).alias("_top"))
    before = Window.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65536 rows
    carried = tops.withColumn("_carry", F.max("_top").over(before)).select("_slab", "_carry")
    inside = Window.partitionBy("_slab").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return slabs.join(carried, "_slab").withColumn("top", F.greatest(F.max(value).over(inside), "_carry")).drop("_slab", "_carry")


def compare(summaries: DataFrame, run: str, names: list[str], base: str, value: str, by: tuple[str, ...]) -> DataFrame:
    """A comparison table: a row for each ``by``, a column for each run of ``names`` with its
    ``value``, and one with its share of the run ``base`` (``name_pct``)."""
    wide = summaries.groupBy(*by).pivot(run, names).agg(F.first(value))
    share = lambda n: F.when(F.col(f"`{base}`") != 0, F.col(f"`{n}`") / F.col(f"`{base}`") * 100)
    return wide.select(*by, *[F.col(f"`{n}`") for n in names], *[share(n).alias(f"{n}_pct") for n in names if n != base])


def percent(value: Column) -> Column:
    """A share as text: no decimals from 10 % on, one from 1 %, two below; 100x and more as
    multiples."""
    p = value * 100
    return F.when(F.abs(value) >= 100, F.format_string("%.0fx", value)).when(F.abs(p) >= 10, F.format_string("%.0f%%", p)).when(F.abs(p) >= 1, F.format_string("%.1f%%", p)).otherwise(F.format_string("%.2f%%", p))


def snapped(value: Column, digits: int = 3) -> Column:
    """A number that is a whole one but for its last ``digits`` significant places becomes it."""
    whole = F.round(value)
    return F.when(F.abs(value - whole) < F.lit(10.0**-digits), whole).otherwise(value)


def duration(seconds: Column) -> Column:
    """Seconds as text: milliseconds below one, minutes and hours above sixty."""
    s = F.round(seconds).cast("long")
    clock = F.format_string("%dm%02ds", F.floor(s / 60), s % 60)
    hours = F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))
    return F.when(seconds < 1, F.format_string("%.0fms", seconds * 1000)).when(seconds < 60, F.format_string("%.1fs", seconds)).when(s < 3600, clock).otherwise(hours)


def as_json(summary_rows: DataFrame, name: str) -> DataFrame:
    """``name, json``: each row of a summary as one JSON text, without its name."""
    rest = [c for c in summary_rows.columns if c != name]
    return summary_rows.select(name, F.to_json(F.struct(*rest)).alias("json"))
