"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[str] = []  # folders of this driver, oldest first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine is set if the master is local
    (tests, a laptop); on a cluster that is an error, for executors don't share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="grove-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: it cuts the lineage and
    survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/grove-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark: what is written from here on can be given up by ``discard``."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete what ``materialize`` wrote between two marks. Only for rows that nothing still
    to be computed goes back to: earlier rounds of a loop, or all once the results are read."""
    for path in _written[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since:until]


SHARE = 10_000  # a key with more than one in so many rows counts as hot


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``n`` how often the key
    stands in the ``total`` rows.

    A hot key would be one task of a shuffle. There are at most ``SHARE`` of them, whatever
    the size of the input, so their rows of ``table`` are broadcast; what isn't among them is
    shuffled.
    """
    hot, mark = F.col(n) > total / SHARE, fresh(table, "hot")
    met = rows.join(F.broadcast(table.where(hot).drop(n).withColumn(mark, F.lit(True))), key, "left")
    done = met.where(F.col(mark)).drop(mark)
    rest = met.where(F.col(mark).isNull()).select(*rows.columns).join(table.where(~hot).drop(n), key)
    return done.unionByName(rest)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
