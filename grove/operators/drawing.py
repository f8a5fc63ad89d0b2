"""Object graphs as lines of the dot language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How each kind of object is drawn.
SHAPES = {"branch": "cds", "commit": "box", "node": "ellipse", "contents": "note"}
STYLES = {"branch": "bold", "commit": "bold", "node": "solid", "contents": "dotted"}


def _name(kind: str, key: str) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(F.col(key), r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), kind if isinstance(kind, Column) else F.col(kind), F.lit(":"), escaped, F.lit('"'))


def _of(table: dict[str, str], kind: Column) -> Column:
    out = F.lit("solid" if table is STYLES else "plain")
    for name, value in table.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def lines(edges: DataFrame, full: bool = True) -> DataFrame:
    """``place, line``: the lines of a drawing of ``object_edges``, in order of ``place`` (0 the
    start, 1 objects, 2 edges, 3 the end). Not ``full``: without contents."""
    rows = edges if full else edges.where("dst_kind <> 'contents'")
    ends = rows.select(F.col("src_kind").alias("kind"), F.col("src").alias("key")).unionByName(rows.select(F.col("dst_kind").alias("kind"), F.col("dst").alias("key"))).distinct()
    objects = ends.select(F.lit(1).alias("place"), F.concat(_name("kind", "key"), F.lit(" [shape="), _of(SHAPES, F.col("kind")), F.lit("];")).alias("line"))
    arrows = rows.select(F.lit(2).alias("place"), F.concat(_name("src_kind", "src"), F.lit(" -> "), _name("dst_kind", "dst"), F.lit(" [style="), _of(STYLES, F.col("dst_kind")), F.lit("];")).alias("line"))
    frame = edges.sparkSession.createDataFrame([(0, "digraph G {"), (3, "}")], "place int, line string")
    return frame.unionByName(objects).unionByName(arrows)
