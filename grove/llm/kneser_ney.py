"""Quality by perplexity under an interpolated modified Kneser-Ney model over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import runs, utf8
from .shared import materialize, table

ORDER = 5  # bytes of an n-gram, at most 7: a gram is the bytes as one long
SLICE = 1 << 20
BATCH = 32 << 20  # bytes of text that are scored together
PACK = 32 << 20  # bytes of rows that a task deals to batches at once
LEVEL = 3  # of zstd, for texts on their way to a batch
SMALL = 4_000_000  # trusted ids up to which they are broadcast; more are joined by shuffle
FOLDS = 5  # one of so many trusted texts is kept from training, to set thresholds
QUANTILE = 0.99  # of those texts, by language
FEW = 100  # a language with fewer of those texts is held to the quantile over all languages


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as an integer; the bytes before a text are 0."""
    n = len(data)
    since = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(n, np.int64)
    for back in range(order - 1, -1, -1):
        byte = np.zeros(n, np.int64)
        byte[back:] = data[: n - back] if back else data
        byte[since < back] = 0
        out = (out << 8) | byte
    return out


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, n`` over all rows of a text column, counted slice by slice before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in runs(offsets, SLICE):
                own = offsets[a : b + 1] - offsets[a]
                found, n = np.unique(grams(np.frombuffer(raw[offsets[a] : offsets[b]], np.uint8), own, order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["gram", "n"])

    return texts.mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and 3 or more, from how many grams have counts of
    1 to 4 (four numbers to the driver). Without such grams: 0.5, 1, 1.5."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first())
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))


def train(texts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each length 1 to ``order``: ``gram, p`` of the grams that were seen, and
    ``context, gamma``, the weight that a context leaves to shorter grams.

    The longest grams have their counts; a shorter one counts the different bytes seen before
    it. All of it are groupings and equi-joins on gram codes, so the model is sharded by
    hash however large it gets; each length is written to the shared folder.
    """
    counts = materialize(count_grams(texts, order), "grams")
    levels = [counts]
    for k in range(order - 1, 0, -1):
        shorter = levels[0].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
        levels.insert(0, materialize(shorter, f"grams{k}"))
    model: list[tuple[DataFrame, DataFrame]] = []
    for k, counts in enumerate(levels, 1):
        d1, d2, d3 = discounts(counts)
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftright("gram", 8).alias("context")
        totals = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(taken).alias("taken"))
        rows = counts.select("gram", context, (F.col("n") - taken).alias("own")).join(totals, "context").withColumn("gamma", F.col("taken") / F.col("total"))
        if k == 1:
            p = rows.select("gram", (F.col("own") / F.col("total") + F.col("gamma") / 256).alias("p"))
        else:
            shorter = model[-1][0].select(F.col("gram").alias("tail"), F.col("p").alias("shorter"))
            rows = rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(shorter, "tail")
            p = rows.select("gram", (F.col("own") / F.col("total") + F.col("gamma") * F.col("shorter")).alias("p"))
        model.append((materialize(p, f"p{k}"), materialize(totals.select("context", (F.col("taken") / F.col("total")).alias("gamma")), f"gamma{k}")))
    return model


def probabilities(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``gram, logp`` (natural) for distinct grams: of the longest part that was seen, times
    the weights of the contexts above it. An unknown context leaves everything (1); a byte
    never seen has what the shortest context leaves, spread over 256."""
    rows = asked.select("gram")
    known, weights = [], []
    for k in range(len(model), 0, -1):
        p, gamma = model[k - 1]
        tail, context = f"t{k}", f"c{k}"
        rows = rows.withColumn(tail, F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(p.select(F.col("gram").alias(tail), F.col("p").alias(f"p{k}")), tail, "left").drop(tail)
        rows = rows.withColumn(context, F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)), 8)).join(gamma.select(F.col("context").alias(context), F.col("gamma").alias(f"g{k}")), context, "left").drop(context)
        known.append(F.col(f"p{k}"))
        weights.append(F.coalesce(F.col(f"g{k}"), F.lit(1.0)))
    value: Column = weights[-1] / 256
    value = F.coalesce(known[-1], value)
    for p, w in zip(known[-2::-1], weights[-2::-1], strict=True):
        value = F.coalesce(p, w * value)
    return rows.select("gram", F.log(value).alias("logp"))


def pack(parts: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch``, text and others, about ``PACK`` bytes at a time, as one row a batch:
    ``batch``, the texts' sizes, their bytes side by side under zstd, and lists of the others."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in parts:
        for a, b in runs(utf8(part.column(1))[1], PACK):
            own = part.slice(a, b - a)
            if held and size + own.nbytes > PACK:
                yield packed(held, names)
                held, size = [], 0
            held.append(own)
            size += own.nbytes
    if size:
        yield packed(held, names)


def packed(held: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    numbers = rows.column(0).to_numpy()
    rows = rows.take(pa.array(np.argsort(numbers, kind="stable"))).combine_chunks()
    found, n = np.unique(numbers, return_counts=True)
    edges = np.concatenate([[0], np.cumsum(n)])
    raw, offsets = utf8(rows.column(1))
    zstd = pa.Codec("zstd", compression_level=LEVEL)
    data = [zstd.compress(raw[offsets[a] : offsets[b]], asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x) for x in (pa.array(np.diff(offsets), pa.int32()), *(c.combine_chunks() for c in rows.columns[2:]))]
    return pa.RecordBatch.from_arrays([pa.array(found), lists[0], pa.array(data, pa.binary()), *lists[1:]], names=names)


def unpack(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of packed rows in their order, about ``SLICE`` bytes at a time or one text
    that has more: the bytes side by side, and where each text starts and ends."""
    held: list[pa.Buffer] = []
    sizes: list[np.ndarray] = []
    total = 0

    def told() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join(held), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        for a, b in runs(offsets, SLICE):
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]

    for own, data in zip(rows.column(1), rows.column(2), strict=True):
        lengths = own.values.to_numpy()
        n = int(lengths.sum(dtype=np.int64))
        if sizes and total + n > SLICE:
            yield from told()
            held, sizes, total = [], [], 0
        if n:
            held.append(pa.decompress(data.as_buffer(), decompressed_size=n, codec="zstd"))
        sizes.append(lengths)
        total += n
    if sizes:
        yield from told()


def perplexities(documents: DataFrame, model: list[tuple[DataFrame, DataFrame]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """``id_col``, the ``keep`` columns, ``n_bytes`` and ``perplexity`` of every row.

    Rows are dealt by hash to batches of about ``BATCH`` bytes, the one shuffle of texts,
    which go compressed. A batch asks for its distinct grams; these, not their occurrences,
    are joined with the model's shards, and the answers go back to the batch. Empty and null
    texts have no perplexity (null); null and repeated ids are kept.
    """
    order = len(model)
    size = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches = max(1, -(-size // BATCH))
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    carried = [id_col, *keep]
    names = ["batch", "size", "packed", *(f"c{i}" for i in range(len(carried)))]
    dealt = documents.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(batches)).alias("batch"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(name) for c, name in zip(carried, names[3:], strict=True)))
    shape = "batch long, size array<int>, packed binary, " + ", ".join(f"{name} array<{kinds[c]}>" for c, name in zip(carried, names[3:], strict=True))
    rows = dealt.mapInArrow(lambda parts: pack(parts, names), shape).repartition("batch").sortWithinPartitions("batch")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come batch by batch, so one batch's grams are held however many a task has.
        number, asked = None, np.zeros(0, np.int64)
        for part in parts:
            numbers = part.column(0).to_numpy()
            for own in np.unique(numbers).tolist():
                if own != number:
                    yield from told(number, asked)
                    number, asked = own, np.zeros(0, np.int64)
                for data, offsets in unpack(part.filter(pa.array(numbers == own))):
                    asked = np.union1d(asked, np.unique(grams(data, offsets, order)))
        yield from told(number, asked)

    def told(number: int | None, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(asked), 1 << 16):
            own = asked[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own)], names=["batch", "gram"])

    # Both uses of what is asked are clustered by gram. They keep the same columns (the filter
    # is always true), so Spark sees one exchange and asks once.
    asked = rows.mapInArrow(ask, "batch long, gram long").repartition("gram")
    distinct = asked.groupBy("gram").agg(F.min("batch").alias("least")).where("least >= 0").select("gram")
    answers = asked.join(probabilities(distinct, model), "gram").select("batch", "gram", "logp")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", n_bytes long, perplexity double"

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        codes, logp = known.column("gram").to_numpy(), known.column("logp").to_numpy()
        order_by = np.argsort(codes)
        codes, logp = codes[order_by], logp[order_by]
        sizes, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for data, offsets in unpack(texts):
            found, which = np.unique(grams(data, offsets, order), return_inverse=True)
            values = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(codes, found)][which])]) if len(found) else np.zeros(1)
            sums.append(values[offsets[1:]] - values[offsets[:-1]])
            sizes.append(np.diff(offsets))
        size = np.concatenate(sizes)
        perplexity = pa.array(np.exp(-np.concatenate(sums) / np.maximum(size, 1)), mask=size == 0)
        columns = [c.combine_chunks().flatten() for c in texts.columns[3:]]
        return pa.table([*columns, pa.array(size), perplexity], names=[*carried, "n_bytes", "perplexity"])

    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)


def quality(documents: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, few: int = FEW) -> DataFrame:
    """``id_col, lang, n_bytes, perplexity, threshold, keep`` of every row.

    Of the rows whose id is among ``trusted_ids``, one of ``FOLDS`` by a hash of the id sets
    thresholds, the others train the model. A language's threshold is that quantile of their
    perplexities; rows without a language are a language of their own. A language with under
    ``few`` such texts has no threshold of its own (null) and is held to the quantile over
    all languages. A row is kept if it has a perplexity no higher than that; empty and null
    texts have none and are not kept. Only if no such text has a perplexity at all, nothing
    is known and every row with a perplexity is kept. Other columns are not looked at.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ids = materialize(trusted_ids.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "trusted")
    side = F.broadcast if ids.count() <= SMALL else lambda df: df
    aside = F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0
    model = train(rows.join(side(ids.where(~aside)), "id", "left_semi").select("text"), order)
    scores = materialize(perplexities(rows, model, "id", "text"), "perplexities")
    held = materialize(scores.join(side(ids.where(aside)), "id", "left_semi").where("perplexity is not null").select("lang", "perplexity"), "held")
    bound = F.percentile_approx("perplexity", quantile, 10_000)
    overall = held.agg(bound).first()[0]
    limits = held.groupBy("lang").agg(bound.alias("threshold"), F.count("*").alias("n")).where(F.col("n") >= few).select(F.col("lang").alias("of"), "threshold")
    limit = F.coalesce("threshold", F.lit(float("inf") if overall is None else overall))
    kept = F.coalesce(F.col("perplexity") <= limit, F.lit(False))
    return scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("of")), "left").select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_bytes", "perplexity", "threshold", kept.alias("keep"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality`` of all ``documents``; trusted are those that ``labels`` marks 1."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
