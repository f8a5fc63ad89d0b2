"""Content-addressed objects: stores, slices, liveness, ranges, chunks and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import hashes
from .graph import settle


GROUP = 4096  # slots that are carried over together
TASK = 1 << 20  # rows that a task orders, about; more rows are dealt to more tasks


def _dealt(rows: DataFrame, count: int, key: str) -> DataFrame:
    """``rows`` by ``key`` in tasks whose number grows with their ``count``, where that makes
    more of them than the session has by itself."""
    tasks = -(-count // TASK)
    return rows.repartition(tasks, key) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def store(values: DataFrame, value: str = "value") -> DataFrame:
    """``hash, value`` of each different value once."""
    return values.where(F.col(value).isNotNull()).select(hashes.contents(F.col(value)).alias("hash"), F.col(value).alias("value")).dropDuplicates(["hash"])


def insert(objects: DataFrame, more: DataFrame) -> DataFrame:
    """What ``more`` has that ``objects`` hasn't; adding twice changes nothing."""
    return more.dropDuplicates(["hash"]).join(objects.select("hash"), "hash", "left_anti")


def lookup(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """``hash, value, intact`` for each key; ``intact`` is false where the value stored under
    a key hashes to another, null where there is none."""
    rows = keys.select("hash").join(objects.select("hash", "value"), "hash", "left")
    return rows.withColumn("intact", hashes.contents(F.col("value")) == F.col("hash"))


def integrity(objects: DataFrame) -> DataFrame:
    """One row: ``entries, corrupted``."""
    bad = hashes.contents(F.col("value")) != F.col("hash")
    return objects.agg(F.count("*").alias("entries"), F.count_if(bad).alias("corrupted"))


def index_check(scan: DataFrame, index: DataFrame) -> DataFrame:
    """``hash, problem``: entries that an index lacks, has too many of, or has elsewhere
    (``hash, offset`` on both sides)."""
    a, b = scan.select("hash", F.col("offset").alias("at")), index.select("hash", F.col("offset").alias("said"))
    problem = F.when(F.col("said").isNull(), "missing").when(F.col("at").isNull(), "unknown").when(F.col("at") != F.col("said"), "elsewhere")
    return a.join(b, "hash", "full_outer").select("hash", problem.alias("problem")).where("problem is not null")


def kinds(objects: DataFrame) -> DataFrame:
    """``kind, entries, distinct_entries, duplicates`` (``kind, hash``)."""
    return objects.groupBy("kind", "hash").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("entries"), F.count("*").alias("distinct_entries"), (F.sum("n") - F.count("*")).alias("duplicates"))


def import_slice(objects: DataFrame, sliced: DataFrame) -> DataFrame:
    """Rows of a slice that are new; a row whose hash isn't that of its value is an error
    when it is used."""
    checked = sliced.withColumn("value", F.when(hashes.contents(F.col("value")) == F.col("hash"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("corrupted slice entry "), F.col("hash"))).cast("string")))
    return insert(objects, checked)


def commit_hash() -> Column:
    """The hash of a commit's row (``node_hash, parents, date, author, message``)."""
    return F.sha1(F.concat_ws("\x1f", F.lit("commit"), "node_hash", F.array_join("parents", ","), F.col("date").cast("string"), "author", "message"))


def _entries_hash(nodes: DataFrame) -> DataFrame:
    """``node_hash, real``: the hash that the entries of each node stand for."""
    entry = F.concat_ws("\x1f", "kind", "step", F.col("child_hash"), F.coalesce("metadata", F.lit("")))
    return nodes.groupBy("node_hash").agg(*hashes.set_sums(entry)).select("node_hash", hashes.set_digest().alias("real"))


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """Entries of nodes; a node whose hash isn't that of its entries is an error when used."""
    right = F.when(F.col("real") == F.col("node_hash"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("corrupted slice node "), F.col("node_hash"))).cast("string"))
    return nodes.join(_entries_hash(nodes), "node_hash").withColumn("kind", right).select(*nodes.columns)


def checked_commits(commits: DataFrame) -> DataFrame:
    """Commits; one whose hash isn't that of its row is an error when used."""
    right = F.when(commit_hash() == F.col("hash"), F.col("hash")).otherwise(F.raise_error(F.concat(F.lit("corrupted slice commit "), F.col("hash"))).cast("string"))
    return commits.withColumn("hash", right).select(*commits.columns)


def problems(wanted: DataFrame, commits: DataFrame, nodes: DataFrame, contents: DataFrame, empty: str) -> DataFrame:
    """``kind, key, problem`` of ``wanted`` objects (``kind, hash``) that are missing from the
    tables, or corrupted: what is stored hashes to another. The ``empty`` node has no entries
    and is never missing."""
    have = commits.select(F.lit("commit").alias("kind"), "hash", commit_hash().alias("real"))
    have = have.unionByName(_entries_hash(nodes).select(F.lit("node").alias("kind"), F.col("node_hash").alias("hash"), "real"))
    have = have.unionByName(contents.select(F.lit("contents").alias("kind"), "hash", hashes.contents(F.col("value")).alias("real")))
    rows = wanted.distinct().join(have, ["kind", "hash"], "left")
    problem = F.when(F.col("real").isNull(), "missing").when(F.col("real") != F.col("hash"), "corrupted")
    return rows.where(F.col("hash") != empty).select("kind", F.col("hash").alias("key"), problem.alias("problem")).where("problem is not null")


def missing(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """``hash, referrers``: what entries (``src, dst``) lead to and no object (``hash``) is,
    and how many objects lead there."""
    return edges.groupBy(F.col("dst").alias("hash")).agg(F.count_distinct("src").alias("referrers")).join(objects.select("hash"), "hash", "left_anti")


def repair(objects: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index (``hash``) without entries that no object has, and one row of what came of it:
    ``outcome`` (ok, fixed n, corrupted n), ``dropped``, ``corrupted``. A value that hashes to
    another can't be mended; it stays, and is what the outcome names."""
    kept = index.join(objects.select("hash"), "hash", "left_semi")
    gone = index.join(objects.select("hash"), "hash", "left_anti").agg(F.count("*").alias("dropped"))
    bad = objects.agg(F.count_if(hashes.contents(F.col("value")) != F.col("hash")).alias("corrupted"))
    n = lambda word, column: F.concat(F.lit(word), F.col(column).cast("string"))
    outcome = F.when(F.col("corrupted") > 0, n("corrupted ", "corrupted")).when(F.col("dropped") > 0, n("fixed ", "dropped")).otherwise("ok")
    return kept, gone.crossJoin(F.broadcast(bad)).select(outcome.alias("outcome"), "dropped", "corrupted")


def coalesce_ranges(ranges: DataFrame, shard: int = 1 << 32) -> DataFrame:
    """``off, len`` of ranges joined where they touch or overlap.

    Gaps and islands inside shards of the address space, each a window of its own. Ranges that
    cross a shard's end are cut there and joined again: an island that touches an end is one
    with that of the next shard, so what is left to order are one row a shard at most, the
    chains of islands that go from end to end.
    """
    ends = F.sequence(F.floor(F.col("off") / shard), F.floor((F.col("end") - 1) / shard))
    rows = ranges.select("off", (F.col("off") + F.col("len")).alias("end")).where("end > off").select("off", "end", F.explode(ends).alias("shard"))
    rows = rows.select("shard", F.greatest("off", F.col("shard") * shard).alias("off"), F.least("end", (F.col("shard") + 1) * shard).alias("end"))
    rows = _dealt(rows, ranges.count(), "shard")
    w = Window.partitionBy("shard").orderBy("off", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(before >= F.col("off"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = marked.groupBy("shard", "island").agg(F.min("off").alias("off"), F.max("end").alias("end"))
    low, high = F.col("off") == F.col("shard") * shard, F.col("end") == (F.col("shard") + 1) * shard
    closed = inside.where(~low & ~high).select("off", "end")
    # At most two islands of a shard touch its ends: these alone are ordered together.
    edge = Window.orderBy("off")
    open_ = inside.where(low | high).withColumn("new", F.when(F.lag("end").over(edge) >= F.col("off"), 0).otherwise(1)).withColumn("chain", F.sum("new").over(edge.rowsBetween(Window.unboundedPreceding, 0)))
    joined = open_.groupBy("chain").agg(F.min("off").alias("off"), F.max("end").alias("end")).select("off", "end")
    return closed.unionByName(joined).select("off", (F.col("end") - F.col("off")).alias("len"))


def locate(offsets: DataFrame, ranges: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``x, off, place``: the range (``off, len``, none overlap) that holds each offset, or
    the next one (before), else null (after).

    An as-of lookup: ranges and offsets are merged by end within address slots of ``width``,
    and the first range at or after a slot is carried back to slots without one: inside groups
    of ``GROUP`` slots first, then over the groups, a row each.
    """
    ends = ranges.select((F.col("off") + F.col("len") - 1).alias("at"), F.lit(1).alias("kind"), F.struct("off", "len").alias("r"), F.lit(None).cast("long").alias("x"))
    asks = offsets.select(F.col("x").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["r"].dataType).alias("r"), F.col("x").cast("long").alias("x"))
    rows = settle(ends.unionByName(asks).withColumn("slot", F.floor(F.col("at") / width)))
    rows = _dealt(rows, rows.count(), "slot")
    back = Window.partitionBy("slot").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("found", F.last("r", ignorenulls=True).over(back)).where("kind = 0")
    slots = rows.groupBy("slot").agg(F.min_by("r", F.when(F.col("kind") == 1, F.col("at"))).alias("first"))
    slots = slots.withColumn("group", F.floor(F.col("slot") / GROUP))
    later = Window.partitionBy("group").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    groups = slots.groupBy("group").agg(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("slot"))).alias("lead"))
    beyond = groups.withColumn("beyond", F.last("lead", ignorenulls=True).over(Window.orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, -1))).select("group", "beyond")
    carried = slots.withColumn("next", F.last("first", ignorenulls=True).over(later)).join(beyond, "group").select("slot", F.coalesce("next", "beyond").alias("next"))
    r = F.coalesce(F.col("found"), F.col("next"))
    place = F.when(r.isNull(), "after").when(F.col("x") >= r["off"], "inside").otherwise("before")
    return here.join(carried, "slot", "left").select("x", r["off"].alias("off"), place.alias("place"))


def chunk(values: DataFrame, size: int, pad: bool = False, value: str = "value") -> DataFrame:
    """``hash, place, chunk, length`` of values cut into pieces of ``size`` characters; ``pad``
    fills the last with NULs, ``length`` is without them. ``hash`` is the whole value's."""
    v = F.col(value)
    n = F.greatest(F.ceil(F.length(v) / size), F.lit(1)).cast("int")
    rows = values.select(hashes.contents(v).alias("hash"), v.alias("v"), F.explode(F.sequence(F.lit(0), n - 1)).alias("place"))
    piece = F.substring("v", F.col("place") * size + 1, F.lit(size))
    return rows.select("hash", "place", (F.rpad(piece, size, "\0") if pad else piece).alias("chunk"), F.length(piece).alias("length"))


def assemble(chunks: DataFrame) -> DataFrame:
    """``hash, value, intact`` of values put together again."""
    parts = F.array_sort(F.collect_list(F.struct("place", F.substring("chunk", F.lit(1), F.col("length")).alias("chunk"))))
    rows = chunks.groupBy("hash").agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("value"))
    return rows.withColumn("intact", hashes.contents(F.col("value")) == F.col("hash"))


def bucket(step: Column, depth: int, bits: int = 5) -> Column:
    """The branch, of 2^bits, that a step takes at a depth of the trie: so many bits of its
    hash from the top."""
    at = depth * bits
    first = at // 4
    digits = F.conv(F.substring(F.sha1(step), first + 1, (at % 4 + bits + 3) // 4), 16, 10).cast("long")
    spare = ((at % 4 + bits + 3) // 4) * 4 - (at % 4) - bits
    return F.shiftright(digits, spare).bitwiseAND(F.lit((1 << bits) - 1))


def indexed(kind: Column, strategy: str) -> Column:
    """Whether a strategy (always, minimal, minimal_with_contents) indexes a kind of entry."""
    return {"always": F.lit(True), "minimal": kind == "commit", "minimal_with_contents": kind.isin("commit", "contents")}[strategy]
