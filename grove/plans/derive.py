"""Trees, histories and traces out of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, d: str) -> DataFrame:
    """A leaf for each order under region, nation and customer."""
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    path = F.array("r_name", "n_name", F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return rows.select(path.alias("path"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("metadata"), F.col("o_orderkey").alias("key"))


GEO = """geo as (
  select '/' || r_name || '/' || n_name || '/' || c_custkey || '/' || o_orderkey as path, r_name as s1, n_name as s2, cast(c_custkey as varchar) as s3, cast(o_orderkey as varchar) as s4,
    o_orderstatus as value, o_orderpriority as metadata, o_orderkey as key
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

OURS = "case when key % 50 = 13 then 'X' when key % 10 = 0 then 'U' else value end"
THEIRS = "case when key % 10 = 0 then 'U' when key % 10 = 3 then 'T' when key % 50 = 21 then 'M' else value end"
VERSIONS = f"""{GEO},
base as (select path, value, metadata from geo),
ours as (select path, {OURS} as value, metadata from geo where key % 10 <> 1 union all select '/NEW/ours/' || key, value, metadata from geo where key % 100 = 5),
theirs as (select path, {THEIRS} as value, metadata from geo where key % 10 <> 2 union all select '/NEW/theirs/' || key, value, metadata from geo where key % 100 = 6)"""


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An order tree and two edited versions of it, with agreeing and clashing edits."""
    rows = geo(spark, d)

    def side(value: str, less: int, name: str, more: int) -> DataFrame:
        kept = rows.where(f"key % 10 <> {less}").select("path", F.expr(value).alias("value"), "metadata")
        new = rows.where(f"key % 100 = {more}").select(F.array(F.lit("NEW"), F.lit(name), F.col("key").cast("string")).alias("path"), "value", "metadata")
        return kept.unionByName(new)

    return rows.select("path", "value", "metadata"), side(OURS, 1, "ours", 5), side(THEIRS, 2, "theirs", 6)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Paths as text."""
    return df.withColumns({c: paths.show(F.col(c)) for c in columns or ("path",)})


def commits(spark: SparkSession, d: str) -> DataFrame:
    """``commit, parent, date``: a commit for each order date in order; every seventh one
    also has the commit of half its number as a parent. The first has a null parent."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    numbered = days.select(F.row_number().over(Window.orderBy("day")).cast("long").alias("commit"))
    second = F.when((F.col("commit") % 7 == 0) & (F.col("commit") > 2), F.array(F.col("commit") - 1, F.floor(F.col("commit") / 2)))
    parents = F.coalesce(second, F.when(F.col("commit") > 1, F.array(F.col("commit") - 1)))
    return numbered.select("commit", F.explode_outer(parents).alias("parent"), F.col("commit").alias("date")).distinct()


COMMITS = """numbered as (select row_number() over (order by day) as commit from (select distinct cast(o_orderdate as date) as day from orders)),
commits as (
  select distinct commit, parent, commit as date from (
    select commit, case when commit > 1 then commit - 1 end as parent from numbered
    union all select commit, commit // 2 from numbered where commit % 7 = 0 and commit > 2))"""


def trace(spark: SparkSession, d: str) -> DataFrame:
    """``row_idx, op, duration``: events in order as operations, every twentieth a Commit."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("row_idx"), F.when(F.col("event_id") % 20 == 19, "Commit").otherwise(F.col("event_type")).alias("op"), F.coalesce(F.round(F.col("value"), 4), F.lit(0.0)).alias("duration"))


TRACE = """trace as (select event_id as row_idx, case when event_id % 20 = 19 then 'Commit' else event_type end as op, coalesce(round(value, 4), 0.0) as duration from events)"""


def number(c: Column) -> Column:
    return c.cast("long")
