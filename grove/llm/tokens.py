"""Token counts of a byte-level BPE vocabulary by compiled transducers (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrow import small, utf8
from .bpe import compiled, slices, split, with_special
from .shared import table

SLICE = 1 << 18  # bytes of text that one pass of the transducers takes


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """Tokens of every whole text: ``id_col, n_bytes, n_tokens, over_limit``.

    One narrow pass, no shuffle. A null text counts as empty (0 bytes, 0 tokens); null and
    repeated ids are kept, a row for each row; other columns of ``df`` are not looked at.
    A text with a special token's string is counted by the library, which sees that string
    as one token.
    """
    file = path or vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(file)
        for batch in small(batches):
            raw, offsets = utf8(batch.column(1))
            counts = np.zeros(len(offsets) - 1, np.int64)
            for a, b, data, lengths in slices(raw, offsets, SLICE):
                words, owner = split(data, lengths)
                counts[a:b] += np.bincount(owner, np.array(bpe.known(words), np.int64), b - a).astype(np.int64)
            for i in with_special(raw, offsets):
                counts[i] = len(bpe.library.encode(bytes(raw[offsets[i] : offsets[i + 1]]).decode(), add_special_tokens=False).ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return df.select(id_col, text_col).mapInArrow(work, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"))
