"""Quartile bucket digests of whole texts, and their bounded difference."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import utf8
from .shared import materialize, table

# The byte triplets of a window of five, the number of buckets, and what a
# difference counts: two bits of a bucket, steps of length, of the two quartile ratios.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
BUCKETS = 256
STEP = (0, 1, 2, 6)
LENGTH_STEP, LENGTH_MOST = 2, 60
RATIO_MOST = 15
SLICE = 1 << 20
MOST = BUCKETS * STEP[3] + LENGTH_MOST + 2 * RATIO_MOST


def counts(text: bytes) -> np.ndarray:
    """How many byte triplets of ``text`` fall into each bucket; any number of bytes, a
    slice at a time."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(text) - 4), SLICE):
        b = np.frombuffer(text, np.uint8, min(SLICE + 4, len(text) - at), at).astype(np.uint32)
        n = len(b) - 4
        for kind, (i, j, k) in enumerate(TRIPLETS):
            x = b[i : i + n] | (b[j : j + n] << np.uint32(8)) | (b[k : k + n] << np.uint32(16))
            h = (x + np.uint32(kind << 24)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(text: bytes) -> bytes:
    """Length on a logarithmic scale, quartile ratios, and two bits for each bucket.

    A text under five bytes has no triplets: all its buckets are 0.
    """
    c = counts(text)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    length = min(255, round(np.log1p(len(text)) * 10))
    ratios = (q1 * 15 // q3 if q3 else 0) << 4 | (q2 * 15 // q3 if q3 else 0)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    return bytes((length, ratios)) + packed.astype(np.uint8).tobytes()


@lru_cache(1)
def _pairs() -> np.ndarray:
    """The difference of two packed bytes of four buckets each."""
    two = np.array([[(x >> s) & 3 for s in (6, 4, 2, 0)] for x in range(256)])
    return np.array(STEP)[np.abs(two[:, None, :] - two[None, :, :])].sum(axis=2)


def difference(a: bytes, b: bytes) -> int:
    """0 for equal digests, ``MOST`` at the most."""
    x, y = np.frombuffer(a, np.uint8, offset=2), np.frombuffer(b, np.uint8, offset=2)
    body = int(_pairs()[x, y].sum())
    length = min(LENGTH_MOST, LENGTH_STEP * max(0, abs(a[0] - b[0]) - 1))
    return body + length + abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` of every row: one narrow pass. Null texts count as empty; null
    and repeated ids are kept; other columns are not looked at."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        raw, at = utf8(texts)
        return pa.array([digest(bytes(raw[a:b])).hex() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

    return df.select(F.col(id_col), of(F.col(text_col)).alias("fingerprint"))


def edit(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(text: str, own: bytes, following: str, next_own: bytes) -> tuple[str, str, float, float]:
    changed = edit(text, following).encode()
    other = digest(changed)
    return hashlib.sha256(changed).hexdigest(), other.hex(), likeness(own, other), likeness(own, next_own)


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with its digest, the digest of its edited text and both likenesses.

    The edited text takes its last third from the next row in descending order of id (nulls
    last; rows of equal id by a hash of the text), the last row from the first. Rows are
    range-partitioned by that order, one shuffle, and each task walks its sorted rows; only
    the last row of a partition needs the first of the next, and these few are joined
    afterwards. Null texts are empty; rows with null or repeated ids are rows like others;
    a table of one row follows itself; other columns are not looked at.
    """
    id_type = df.schema[id_col].dataType
    results = [T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_chars", T.LongType()), *results, T.StructField("part", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())])
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = (F.desc_nulls_last("id"), F.asc("tie"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        ids = None

        def made(out: list, keys: pa.Array) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[f.name for f in schema])

        for batch in batches:
            if not batch.num_rows:
                continue
            out, texts = [], batch.column(1).to_pylist()
            keys = batch.column(0)
            for text in texts:
                own = digest(text.encode())
                if held is not None:
                    before, mark, head = held
                    sha, other, near, far = _compare(before, mark, text, own)
                    out.append((len(before), sha, mark.hex(), other, near, far, part, head, None))
                held, first = (text, own, text if first else None), False
            # The key of a held row comes with the next batch's rows.
            pending = keys if ids is None else pa.concat_arrays([ids, keys])
            yield made(out, pending.slice(0, len(out)))
            ids = pending.slice(len(out))
        if held is not None:
            before, mark, head = held
            yield made([(len(before), None, mark.hex(), None, None, None, part, head, before)], ids)

    done = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(walk, schema), "digests")
    # One row for each partition that has rows: its place in the order.
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = done.where(F.col("head").isNotNull()).select("part", "head", F.row_number().over(Window.orderBy("part")).alias("place"), F.count("*").over(every).alias("last"))
    heads = places.select(F.col("place").alias("next"), F.col("head").alias("following"))
    following = places.select("part", (F.col("place") % F.col("last") + 1).cast("int").alias("next")).join(heads, "next").drop("next")

    @F.pandas_udf("edited_sha256 string, edited_fingerprint string, near_edited double, near_next double")
    def finish(text: pd.Series, after: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_compare(t, digest(t.encode()), x, digest(x.encode())) for t, x in zip(text, after, strict=True)], columns=["edited_sha256", "edited_fingerprint", "near_edited", "near_next"])

    names = [f.name for f in results]
    ends = done.where(F.col("tail").isNotNull()).select("id", "n_chars", "fingerprint", "part", "tail").join(following, "part").select("id", "n_chars", "fingerprint", finish("tail", "following").alias("r")).select("id", "n_chars", "fingerprint", "r.*")
    whole = done.where(F.col("tail").isNull()).select("id", "n_chars", *names).unionByName(ends.select("id", "n_chars", *names))
    return whole.withColumnRenamed("id", id_col)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ``documents`` and of their edited texts, and how alike they are."""
    return edited_likeness(table(spark, sf_dir, "documents"))
