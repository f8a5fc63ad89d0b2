"""Benchmark decontamination: approximate matches of test items inside documents."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table

RATE = 0.05  # edits allowed by character of an item
SHORTEST = 32  # characters below which an item is searched word for word
BLOCK = 4_000_000  # characters of items that one pass of the documents searches


def normal(text: Column) -> Column:
    """Lower case; everything but letters and digits becomes one space (null: empty)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def best_end(pattern_bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of ``text`` and where that part ends,
    by Myers' bit-parallel columns: the whole pattern is one machine word of ``length`` bits."""
    mask, high = (1 << length) - 1, 1 << (length - 1)
    up, down, here = mask, 0, length
    best, end = length, 0
    for i, c in enumerate(text, 1):
        equal = pattern_bits.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise = (down | ~(horizontal | up)) & mask
        fall = up & horizontal
        if rise & high:
            here += 1
        elif fall & high:
            here -= 1
        rise, fall = (rise << 1) & mask, (fall << 1) & mask
        up, down = (fall | ~(vertical | rise)) & mask, rise & vertical
        if here < best:
            best, end = here, i
    return best, end


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """Test items, their pieces in one automaton, and the search of a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(key, text, int(rate * len(text)) if len(text) >= SHORTEST else 0, bits(text)) for key, text in items]
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget, _) in enumerate(self.items):
            # One piece more than edits: some piece stays whole, at most ``budget`` away.
            for i in range(budget + 1):
                a, b = i * len(text) // (budget + 1), (i + 1) * len(text) // (budget + 1)
                places.setdefault(text[a:b], []).append((n, a))
        for piece, own in places.items():
            self.pieces.add_word(piece, (len(piece), own))
        if places:
            self.pieces.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """Items in a normalised text: ``key, distance, end`` of the best match of each."""
        windows: dict[int, list[list[int]]] = {}
        if len(self.pieces):
            for stop, (size, own) in self.pieces.iter(text):
                for n, a in own:
                    _, item, budget, _ = self.items[n]
                    start = stop + 1 - size - a
                    if size < SHORTEST and size == len(item) and not (text[start - 1 : start] in ("", " ") and text[stop + 1 : stop + 2] in ("", " ")):
                        continue  # a short item in the middle of a word
                    lo, hi = start - budget, start + len(item) + budget
                    spans = windows.setdefault(n, [])
                    if spans and lo <= spans[-1][1]:  # one scan for hits that overlap
                        spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
                    else:
                        spans.append([lo, hi])
        out = []
        for n, spans in windows.items():
            key, item, budget, table = self.items[n]
            if len(item) < SHORTEST:
                out.append((key, 0, spans[0][1]))
                continue
            if (at := text.find(item)) >= 0:
                out.append((key, 0, at + len(item)))
                continue
            best, end = budget + 1, 0
            for lo, hi in spans:
                d, e = best_end(table, len(item), text[max(0, lo) : hi])
                if d < best:
                    best, end = d, max(0, lo) + e
            if best <= budget:
                out.append((key, best, end))
        return out


def _keyed(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, body, key``: equal items have one key, by which hits find all their ids again."""
    rows = benchmark.select(F.col(item_col).alias("item"), normal(F.col(text_col)).alias("body")).where("body <> ''")
    return rows.withColumn("key", F.xxhash64("body"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The different items in blocks of a bounded size, so that what goes to each task is
    bounded however long the benchmark is; each block is one pass of the documents."""
    bodies = items.select("key", "body").distinct()
    size = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    for b in range(blocks):
        rows = bodies.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        yield sorted((r.key, r.body) for r in rows)


def hits(text: Column, items: list[tuple[int, str]], rate: float = RATE) -> Column:
    """An array of ``key, distance, end`` for a normalised text column."""

    @F.pandas_udf("array<struct<key:long,distance:int,end:int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Items(items, rate)
        for texts in batches:
            yield pd.Series([[{"key": k, "distance": d, "end": e} for k, d, e in own.search(t)] for t in texts])

    return of(text)


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """Benchmark items that stand in documents with few edits: ``id_col, item_id, distance,
    end, weak``, one row for each document and item.

    ``distance`` is the least edit distance of the item to any part of the document, both
    normalised, at most ``rate`` of the item's length; ``end`` is where the best part ends in
    the normalised text. An item under ``SHORTEST`` characters is found only word for word,
    and ``weak`` says that it may stand there by chance. Null and empty texts, and items
    without a letter or digit, match nothing; of equal items each is reported; null and
    repeated document ids are kept; other columns are not looked at.
    """
    items, found = _keyed(benchmark, item_col, item_text), None
    for block in _blocks(items):
        own = documents.select(F.col(id_col).alias("document"), hits(normal(F.col(text_col)), block, rate).alias("hit")).select("document", F.inline("hit"))
        found = own if found is None else found.unionByName(own)
    weak = (F.length("body") < SHORTEST).alias("weak")
    return found.join(items, "key").select(F.col("document").alias(id_col), F.col("item").alias(item_col), "distance", "end", weak)


def without_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``documents`` in which no item of ``benchmark`` stands, short ones word for
    word; all columns stay. Null and empty texts stay, repeated rows stay or go together; an
    empty benchmark takes nothing."""
    own, kept = fresh(documents, "hits"), documents
    for block in _blocks(_keyed(benchmark, item_col, item_text)):
        kept = kept.withColumn(own, hits(normal(F.col(f"`{text_col}`")), block, rate)).where(F.size(own) == 0).drop(own)
    return kept.select(*documents.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``leaks`` of the items of ``benchmark`` in all ``documents``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
