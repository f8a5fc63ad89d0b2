"""Pairs of texts whose word shingles have a given Jaccard similarity: SimHash and MinHash
find candidates, the shingles themselves decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import utf8
from .components import components
from .shared import join_counted, materialize

SEED = 42
BANDS, ROWS = 30, 6  # a pair at similarity s shares a band with 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8
SLICE = 1 << 16  # shingles that are hashed at once
PART = 1 << 19  # shingles of a candidate group above which it is dealt to several tasks
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 of the shingles, sorted. Words and short texts are those of ``simhash``."""
    w = text.lower().split()
    n = max(1, len(w) - words + 1) if w else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def node(own: np.ndarray) -> int:
    """One number (a signed long) for equal sets of shingles; 0 for none."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)) if len(own) else 0


def print_of(own: np.ndarray) -> int:
    """The SimHash (a signed long) of a set of shingles, each counted once, so that equal sets
    have equal ones: a bit is set if it is in over half of them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), SLICE):
        ones += np.unpackbits(own[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def shingle_node(text: Column, words: int) -> Column:
    """The node of a text column (null: 0, as for no words)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw, at = utf8(texts)
        return pa.array([node(shingles(bytes(raw[a:b]), words)) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())

    return of(text)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` hashes for each set (none may be empty), each of ``ROWS`` minima."""
    out = np.empty((len(sets), BANDS), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= SLICE:
            size += len(sets[to])
            to += 1
        h = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for band in range(BANDS):
            mixed = np.full(to - at, band + 1, np.uint64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                mixed = (mixed ^ np.minimum.reduceat(h * _FACTORS[i] + _TERMS[i], starts)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            out[at:to, band] = mixed
        at = to
    return out


def nodes(df: DataFrame, words: int) -> DataFrame:
    """``id, text`` to ``id, node, size, fp, bands``: the shingle set's number, its size, its
    SimHash and its band hashes (none for a text without words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                raw, at = utf8(part.column(1))
                sets = [shingles(bytes(raw[a:b]), words) for a, b in zip(at[:-1], at[1:], strict=True)]
                sizes = np.array([len(s) for s in sets], np.int64)
                hashes = bands([s for s in sets if len(s)]).view(np.int64).ravel()
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                columns = [part.column(0), pa.array([node(s) for s in sets], pa.int64()), pa.array(sizes), pa.array([print_of(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "size", "fp", "bands"])

    return df.mapInArrow(work, f"id {df.schema['id'].dataType.simpleString()}, node long, size long, fp long, bands array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``text`` to ``node, shingles``, the latter as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                raw, at = utf8(batch.slice(begin, 512).column(0))
                sets = [shingles(bytes(raw[a:b]), words) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(work, "node long, shingles binary")


def forest(names: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what is similar enough, directly or through others; every pair that
    is not joined already is compared by an index from shingles to sets."""
    names, first = np.unique(names, return_index=True)
    sets = [sets[i] for i in first]
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(values)))])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    rest = np.ones(len(sets), bool)
    out = []
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root] = False
        queue = [root]
        while queue and rest.any():
            x = queue.pop()
            own = codes[edges[x] : edges[x + 1]]
            many = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            found = np.flatnonzero(rest & (shared / (sizes + sizes[x] - shared) >= similarity))
            rest[found] = False
            queue.extend(found.tolist())
            out.extend((int(names[x]), int(names[y])) for y in found)
    return out


def _near_prints(distinct: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` between nodes whose SimHashes are equal, or linked by ``near``."""
    worded = distinct.where("size > 0").select("node", "fp")
    prints = materialize(worded.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "prints")
    same = join_counted(worded, prints.where("n > 1"), "fp", "n", distinct.count()).select(F.col("node").alias("a"), F.col("first").alias("b"))
    side = lambda end: prints.select(F.col("fp").alias(end), F.col("first").alias(f"of_{end}"))
    linked = near(prints.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.unionByName(linked)


def similar_links(distinct: DataFrame, df: DataFrame, words: int, similarity: float, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` between nodes with that Jaccard similarity at least, thinned to forests.

    ``distinct`` has one row ``node, size, fp, bands, least`` for each set of shingles; ``df``
    has the rows ``id, text`` they come from. Nodes whose SimHashes are equal or linked by
    ``near`` are candidates, and so are those that share a band of MinHash; their components are groups in which all pairs are compared, so thinning candidates loses none.
    A group of over ``PART`` shingles is cut into parts by hash, and each pair of parts is
    searched in a task of its own.
    """
    keys = distinct.select("node", F.explode("bands").alias("band"))
    firsts = keys.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("first != last").select("band", "first", "n")
    banded = join_counted(keys, firsts, "band", "n", BANDS * distinct.count()).select(F.col("node").alias("a"), F.col("first").alias("b"))
    coarse = materialize(components(_near_prints(distinct, near).unionByName(banded), "candidates").join(distinct.select("node", "size", "least"), "node"), "groups")
    parts = coarse.groupBy("root").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts"), F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(F.col("node") + 1), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, part).alias("i"), F.greatest(i, part).alias("j")))
    keyed = join_counted(coarse, parts, "root", "n", coarse.count()).select("node", F.explode(pairs).alias("p"), "root").select("node", F.xxhash64("root", "p.i", "p.j").alias("key"))
    wanted = coarse.where("least is not null").select(F.col("least").alias("id")).distinct()
    # A row's id may stand for several texts; what is in no group falls out of the join by node.
    texts = df.join(wanted, "id", "left_semi").select("text").unionByName(df.where("id is null").select("text"))
    dealt = _sets(texts, words).join(keyed, "node").select("key", "node", "shingles")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets, out = None, [], [], []
        for batch in (*batches, None):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, 0, b"")]
            for key, name, raw in rows:
                if key != last:
                    if len(names) > 1:
                        out.extend(forest(np.array(names, np.int64), sets, similarity))
                    last, names, sets = key, [], []
                names.append(name)
                sets.append(np.frombuffer(raw, np.uint64))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                out = []

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long").distinct()


def similar_groups(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, root, component_id`` of every set of shingles: nodes with one root are joined
    by links, ``component_id`` is their smallest id (null: they have none)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = materialize(nodes(rows, words), "nodes")
    distinct = materialize(own.groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    linked = components(similar_links(distinct, rows, words, similarity, near), "similar")
    rooted = materialize(distinct.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "rooted")
    lowest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "lowest")
    return join_counted(rooted, lowest, "root", "n", rooted.count()).select("node", "root", "component_id")
