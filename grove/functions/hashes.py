"""Digests of contents, and digests of sets that need no sort."""

from __future__ import annotations

import hashlib
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENTS_PREFIX = "B"  # Fixed value: keeps contents apart from nodes and commits


def contents(value: Column, prefixed: bool = True) -> Column:
    """The key of a contents value."""
    return F.sha1(F.concat(F.lit(CONTENTS_PREFIX), value)) if prefixed else F.sha1(value)


def digest(value: Column, algorithm: str, size: int | None = None) -> Column:
    """SHA-1 and SHA-2 in the JVM; BLAKE2, of ``size`` bytes or the most it has, and RIPEMD-160
    (where the machine's OpenSSL has it) through hashlib, by Arrow batches."""
    if algorithm == "sha1":
        return F.sha1(value)
    if algorithm.startswith("sha") and algorithm[3:] in ("224", "256", "384", "512"):
        return F.sha2(value, int(algorithm[3:]))
    if algorithm not in ("blake2b", "blake2s", "ripemd160"):
        raise ValueError(f"no such digest: {algorithm}")
    options = {} if size is None else {"digest_size": size}

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        make = getattr(hashlib, algorithm) if algorithm.startswith("blake2") else partial(hashlib.new, algorithm)
        return values.map(lambda v: make(v.encode(), **options).hexdigest(), na_action="ignore")

    return of(value)


def short(hexed: Column) -> Column:
    """The first eight bytes, least first, as an integer of 63 bits with a sign."""
    swapped = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    low = F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    high = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long")
    # Of the 64 bits the highest is lost, and the one below it becomes the sign.
    return F.shiftright(F.shiftleft(high, 33), 1).bitwiseOR(low)


def set_sums(entry: Column) -> list[Column]:
    """Aggregates that identify a set of distinct strings in any order: their number and the
    sums of two 60-bit parts of their SHA-1. They combine on the map side, so a set of any
    size is never gathered."""
    part = lambda at: F.conv(F.substring(F.sha1(entry), at, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("n"), F.sum(part(1)).cast("decimal(38,0)").alias("s1"), F.sum(part(16)).cast("decimal(38,0)").alias("s2")]


def set_digest() -> Column:
    """One digest of what ``set_sums`` found."""
    return F.sha1(F.concat_ws(",", F.col("n").cast("string"), F.col("s1").cast("string"), F.col("s2").cast("string")))
