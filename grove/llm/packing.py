"""Packing of tokenised documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import small, utf8
from .bpe import ids as own_ids
from .bpe import slices, split, with_special
from .shared import table
from .tokens import SLICE, vocabulary

CAPACITY = 2048
GROUP = 8192  # documents that one task packs together


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document as ids and one end id, cut into pieces of at most ``capacity``.

    Returns ``id_col, piece, start, length, ids_crc32, copy`` and, ``with_ids``, ``ids``;
    ``copy`` numbers rows of one id that came close together. Only a document of more than ``capacity`` ids is cut; its first piece may be shorter, all
    others are full. A null text is empty: its one piece holds the end id alone.
    """
    file = path or vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = own_ids(file)
        end = np.array([end_id], "<u4").tobytes()
        copies: Counter = Counter()
        for batch in small(batches):
            if len(copies) > GROUP:
                copies.clear()
            raw, offsets = utf8(batch.column(1))
            parts: list[list[bytes]] = [[] for _ in range(len(batch))]
            for a, b, data, lengths in slices(raw, offsets, SLICE):
                words, owner = split(data, lengths)
                edges, known = np.searchsorted(owner, np.arange(b - a + 1)).tolist(), bpe.known(words)
                for i in range(b - a):
                    parts[a + i].append(b"".join(known[edges[i] : edges[i + 1]]))
            for i in with_special(raw, offsets):
                parts[i] = [np.array(bpe.library.encode(bytes(raw[offsets[i] : offsets[i + 1]]).decode(), add_special_tokens=False).ids, "<u4").tobytes()]
            rows, out = [], []
            for i, (key, own) in enumerate(zip(batch.column(0).to_pylist(), parts, strict=True)):
                copy = copies[key]
                copies[key] += 1
                whole = b"".join([*own, end])
                n = len(whole) // 4
                cut = n % capacity or capacity if n > capacity else n
                at, piece = 0, 0
                while at < n:
                    cutting = whole[4 * at : 4 * cut]
                    rows.append(i)
                    out.append((piece, at, cut - at, zlib.crc32(cutting), copy, cutting if with_ids else None))
                    at, cut, piece = cut, cut + capacity, piece + 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:5])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("copy", T.LongType())])
    if with_ids:
        schema = T.StructType([*schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(work, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """A bin and an offset for each length, given in descending order.

    An item goes to the open bin for which the sum over all gaps of the squared number of
    open bins with that gap becomes smallest, ties to the smallest gap; a bin is opened
    only when no open one has room. (The rule that weighs a new bin against open ones is
    meant for items that come in any order; in descending order it opens about 0.4 % more.)
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_open = np.zeros(capacity + 1, np.int64)
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        cost = 2 * (n_open[: capacity + 1 - size] - n_open[size:])
        cost[0] = -2 * n_open[size] - 1  # a bin that becomes full is no longer open
        fits = n_open[size:] > 0
        if fits.any():
            gap = size + int(np.where(fits, cost, np.iinfo(np.int64).max).argmin())
            where = open_bins[gap].pop()
            n_open[gap] -= 1
        else:
            gap, where, used = capacity, used, used + 1
        bins[i], offsets[i] = where, capacity - gap
        if gap > size:
            open_bins[gap - size].append(where)
            n_open[gap - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, documents: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash to groups of about ``group`` documents, which are packed
    apart from each other, longest piece first: one shuffle of a few numbers a piece, and
    no group grows with the corpus. Each group leaves at most a few sequences part filled.
    Equal rows are packed as rows of their own, and dealt by ``copy`` too, so a row that is
    repeated without end doesn't fill one group.
    """
    groups = max(1, -(-documents // group))
    fields = [f for f in pieces.schema if f.name != "copy"]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", names[0], "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = bins * groups + key[0], offsets
        return rows[[*names, "sequence_id", "offset"]]

    bucket = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in (names[0], "piece", "ids_crc32", "copy"))), F.lit(groups)).alias("g")
    return pieces.groupBy(bucket).applyInPandas(work, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents packed into sequences: a row for each piece, with the sequence that holds it
    and its place there (gapless from 0).

    Null texts are empty documents of one end id; null and repeated ids are kept, each row
    is a document; an empty table gives no rows; other columns are not looked at.
    """
    return pack(token_pieces(df, id_col, text_col, capacity, 0, path, with_ids), df.count(), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack_documents`` of all ``documents``."""
    return pack_documents(table(spark, sf_dir, "documents"))
