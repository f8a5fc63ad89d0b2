"""SimHash fingerprints and near-duplicate groups through pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import utf8
from .components import components
from .jaccard import shingle_node, similar_groups
from .shared import fresh, join_counted, materialize, table

SEED = 42
BITS = 64
SLICE = 1 << 16  # shingles whose bits are counted at once
LARGE = 512  # a block of more fingerprints is searched one by one
SPLIT = 1 << 15  # a block of more fingerprints is dealt to several tasks


def simhash(text: bytes, words: int) -> int:
    """Bit i is set if it is set in over half the XXH64 of the shingles, repeats included.

    A-Z count as a-z, words part at ASCII white space. A text of fewer words is one shingle;
    one without words has fingerprint 0.
    """
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(at, min(n, at + SLICE))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int) -> Column:
    """The fingerprint of a text column as a signed long (null: 0, as for no words)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw, at = utf8(texts)
        own = np.array([simhash(bytes(raw[a:b]), words) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
        return pa.array(own.view(np.int64))

    return of(text)


def plan(distinct: int, max_bits: int) -> tuple[int, int]:
    """Blocks to cut the fingerprint into, and blocks that must agree.

    Of b blocks, a pair that differs in ``max_bits`` bits agrees in b - max_bits at least:
    one key for each choice of that many blocks loses no pair. More blocks make more keys,
    each shared by fewer strangers; the least sum of keys and (dearer by the row, cheaper
    by the piece) comparisons is taken. No choice changes the result.
    """

    def cost(agree: int) -> float:
        keys, bits = comb(max_bits + agree, agree), BITS * agree / (max_bits + agree)
        return keys + 0.05 * distinct * keys / 2**bits

    agree = min(range(1, 9), key=cost)
    return max_bits + agree, agree


def _keys(fp: Column, blocks: int, agree: int) -> Column:
    """An array of keys, one for each choice of ``agree`` blocks: its number and those bits."""
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum((1 << edge[i + 1]) - (1 << edge[i]) for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def _forest(fps: np.ndarray, max_bits: int, out: list) -> None:
    """Links that join what is within ``max_bits``, directly or through others: at most one
    fewer than there are fingerprints. What is reached leaves the search."""
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                out.append(np.stack([np.full(len(found), x), found]))
                queue.extend(found)
                rest = rest[~near]


def _blocks(key: np.ndarray, fps: np.ndarray, max_bits: int) -> list:
    """Links inside each run of equal keys."""
    out: list = []
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edges)
    number = np.repeat(np.arange(len(sizes)), sizes)
    hit = sizes > LARGE
    small = ~hit[number]
    step = 1
    most = int(sizes[~hit].max(initial=1))
    while step < most:
        same = (number[step:] == number[:-step]) & small[step:]
        at = np.flatnonzero(same)
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits
        hit[number[at[near]]] = True
        step += 1
    for g in np.flatnonzero(hit):
        _forest(fps[edges[g] : edges[g + 1]], max_bits, out)
    return out


def hamming_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints (one column ``fp``) to links ``(a, b)`` whose components are
    those of all pairs within ``max_bits``; links inside a block are thinned to a forest.

    A block that holds over ``SPLIT`` fingerprints is cut into parts by hash, and each pair
    of parts is searched in a task of its own, so no block has to fit one task.
    """
    blocks, agree = plan(fps.count(), max_bits)
    keys = fps.select("fp", F.explode(_keys(F.col("fp"), blocks, agree)).alias("k")).select("fp", F.xxhash64("k.choice", "k.bits").alias("key"))
    large = keys.groupBy("key").count().where(F.col("count") > SPLIT).select("key", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.col("fp") + 1), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, part).alias("i"), F.greatest(i, part).alias("j")))
    large_keys = keys.join(large, "key").select("fp", "key", F.explode(pairs).alias("p")).select("fp", F.xxhash64("key", "p.i", "p.j").alias("key"))
    dealt = keys.join(large.select("key"), "key", "left_anti").select("fp", "key").unionByName(large_keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in (*batches, None):
            if batch is not None:
                key = np.concatenate([key, batch.column(1).to_numpy(zero_copy_only=False)])
                fp = np.concatenate([fp, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
                if not len(key):
                    continue
                end = int(np.searchsorted(key, key[-1]))  # the last block may go on
            else:
                end = len(key)
            if end:
                out = _blocks(key[:end], fp[:end], max_bits)
                if out:
                    a, b = np.concatenate(out, axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                key, fp = key[end:], fp[end:]

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """Every row with its fingerprint and group: ``id_col, fingerprint, component_id``.

    ``component_id`` is the smallest id that can be reached through fingerprints that differ
    in ``max_bits`` bits or fewer. Equal fingerprints are one node whatever their number, so
    a group of copies makes no pairs. Null texts have fingerprint 0 like texts without
    words; a null id is kept, and is the group's id only if all its ids are null; repeated
    rows are kept; an empty table gives no rows.
    """
    own = materialize(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    least = materialize(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    nodes = components(hamming_links(least.select("fp"), max_bits), "simhash")
    joined = nodes.join(least, nodes.node == least.fp)
    roots = joined.groupBy("root").agg(F.min("least").alias("lowest"))
    linked = nodes.join(roots, "root").select(F.col("node").alias("fp"), "lowest")
    groups = materialize(least.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id"), "n"), "groups")
    return join_counted(own, groups, "fp", "n", own.count()).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bits: int = 4) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group the row with the smallest id.

    Groups are of texts that can be reached through pairs whose sets of shingles have that
    Jaccard similarity at least. Candidates are texts whose SimHashes differ in ``max_bits``
    bits or fewer, found by blocks, and, for SimHash alone misses many at 0.8, those that
    share a band of MinHash; the shingles decide. Several rows with that id: one stays, the same in every run
    (by hash of the text, then the other columns as JSON). Rows without an id go if a row
    with an id is in their group; else one stays for each group.
    """
    group, rank, number = (fresh(df, stem) for stem in ("group", "rank", "node"))
    groups = similar_groups(df, id_col, text_col, words, similarity, lambda fps: hamming_links(fps, max_bits))
    # Of the rows with an id, the one that gives its group the smallest id is in that group.
    chosen = groups.where("component_id is not null").select(F.col("component_id").alias(id_col)).distinct()
    rows = df.join(chosen, id_col, "left_semi")
    # Ids that stand in several rows are few or none; only their rows are ranked.
    repeated = df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    once, often = rows.join(repeated, id_col, "left_anti"), rows.join(repeated, id_col, "left_semi")
    alone = groups.where("component_id is null").select(F.col("node").alias(number), F.col("root").alias(group))
    nameless = df.where(F.col(id_col).isNull()).withColumn(number, shingle_node(F.col(text_col), words)).join(alone, number).drop(number)
    ranked = often.withColumn(group, F.lit(0).cast("long")).unionByName(nameless)
    order = Window.partitionBy(id_col, group).orderBy(F.xxhash64(text_col), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    first = ranked.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return once.select(*df.columns).unionByName(first.select(*df.columns))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all ``documents``: four words, four bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)
