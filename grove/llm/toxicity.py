"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, table

# Features of a text are its distinct words and, counted by distinct words,
# the beginnings of longer words.
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
POSITIVES, UNLABELLED = 3000, 6000  # bounds of the training sample, in rows
LEAST, LIFT = 0.03, 3.0  # share of positives that have a feature; times its share at large
SAMPLE = 64 << 20  # bytes of text of either side of the training sample
NOTHING = -60.0  # the bias of a model that knows of no toxic text
BUCKETS = 1 << 20  # counters by which rare features are told
KEEP = 50_000  # words whose weight a worker remembers


def _of_word(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


class Model:
    """A linear classifier: weights of features and a bias; picklable and small."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        weights, known = self.weights, {}

        def weight(word: str) -> float:
            if (w := known.get(word)) is None:
                if len(known) > KEEP:
                    known.clear()
                w = known[word] = sum(weights.get(f, 0.0) for f in _of_word(word))
            return w

        # Sorted, so that equal texts get the same sum in every process.
        return lambda text: 1 / (1 + np.exp(-np.clip(self.bias + sum(sorted(map(weight, set(WORD.findall(text.lower()))))), -60, 60)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _flat(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of all rows side by side, the row of each, and the number of rows."""
    return np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags)


def _logits(w: np.ndarray, index: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(owner, w[index], size) + w[-1]


def corrected_risk(w: np.ndarray, pos: tuple, unl: tuple, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights ``w`` (the bias last), and the gradient to follow: its
    own, or where the part on negatives is below zero that part's turned round."""

    def gradient(slopes: np.ndarray, index: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
        g = np.bincount(index, slopes[owner], len(w))
        g[-1] = slopes.sum()
        return g / size

    zp, zu = _logits(w, *pos), _logits(w, *unl)
    # Logistic loss: l(+) = log(1 + e^-z), l(-) = log(1 + e^z).
    on_positives = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_negative = gradient(_sigmoid(zu), *unl) - prior * gradient(_sigmoid(zp), *pos)
    if negative < 0:
        return float(on_positives), -g_negative
    return float(on_positives + negative), prior * gradient(_sigmoid(zp) - 1, *pos) + g_negative


def train(positive: list[str], unlabelled: list[str], prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-3) -> Model:
    """Minimise the non-negative PU risk of a logistic classifier by Adam, all
    rows at each step.

    With class prior p, positives P and unlabelled U the risk is
    p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)]). The second part estimates the risk on
    negatives; where it falls below zero the classifier is overfitted, and its gradient is
    turned round. At last the bias is moved until the unlabelled rows score the prior on
    average: a small sample would leave it anywhere. Without positives, or without a feature
    that tells them from the rest, nothing is known and every score is 0 (under 1e-25).
    """
    prior = min(max(prior, 1e-3), 0.999)
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model({}, NOTHING)
    features = lambda text: (f for w in set(WORD.findall(text.lower())) for f in _of_word(w))
    # Features are kept that stand in enough positives, and there oftener than at large. Only
    # those of the first kind are looked for in the other rows, so little is held.
    least = max(3, LEAST * len(positive))
    # Most features are rare: those of a bucket that is met too seldom are not held at all.
    met = np.zeros(BUCKETS, np.int64)
    for t in positive:
        np.add.at(met, np.fromiter((hash(f) % BUCKETS for f in set(features(t))), np.int64), 1)
    often = met >= least
    in_p = Counter(f for t in positive for f in set(features(t)) if often[hash(f) % BUCKETS])
    number = {f: i for i, f in enumerate(sorted(f for f, n in in_p.items() if n >= least))}
    bags, others = ([np.sort(np.array([number[f] for f in features(t) if f in number], np.int64)) for t in x] for x in (positive, unlabelled))
    in_u = np.bincount(np.concatenate([np.unique(b) for b in others]), minlength=len(number))
    chosen = [f for f, i in number.items() if in_p[f] / len(positive) >= LIFT * in_u[i] / len(unlabelled)]
    if not chosen:
        return Model({}, NOTHING)
    vocabulary = {f: i for i, f in enumerate(chosen)}
    place = np.full(len(number), -1)
    place[[number[f] for f in chosen]] = np.arange(len(chosen))
    pos, unl = ([y[y >= 0] for y in (place[b] for b in x)] for x in (bags, others))
    n = len(vocabulary)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = base

    pos, unl = _flat(pos), _flat(unl)
    for step in range(1, steps + 1):
        _, g = corrected_risk(w, pos, unl, prior)
        g[:n] += l2 * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    zu, lo, hi = _logits(w, *unl), -60.0, 60.0
    for _ in range(60):
        shift = (lo + hi) / 2
        lo, hi = (lo, shift) if _sigmoid(zu + shift).mean() > prior else (shift, hi)
    w[n] += lo
    names = list(vocabulary)
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:n]) > 1e-3)}, float(w[n]))


def held_out(id_col: Column) -> Column:
    """Rows from which no label is learnt."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample: the first ``POSITIVES`` toxic and ``UNLABELLED`` unlabelled
    rows by a hash of the id, whole texts, as far as ``SAMPLE`` bytes go on either side. The
    class prior is the share of toxic rows among all labelled ones. Rows that are held out
    give neither. Of an id with several rows the least text is taken."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    prior = own.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    order = F.xxhash64(F.col(id_col))
    ids = lambda rows, n: rows.select(id_col).distinct().orderBy(order, id_col).limit(n)
    usable = documents.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = ids(own.where(F.col(label_col) == 1), POSITIVES).withColumn("side", F.lit(1)).unionByName(ids(usable, UNLABELLED).withColumn("side", F.lit(0)))
    rows = documents.select(id_col, F.coalesce(text_col, F.lit("")).alias("body")).join(F.broadcast(chosen), id_col)  # at most POSITIVES + UNLABELLED ids
    single = rows.groupBy("side", id_col).agg(F.min("body").alias("body"))
    so_far = F.sum(F.octet_length("body")).over(Window.partitionBy("side").orderBy(order, id_col))
    got = sorted((r.side, r.body) for r in single.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE).select("side", "body").toLocalIterator())
    return train([t for side, t in got if side], [t for side, t in got if not side], 0.0 if prior is None else float(prior))


def score(text: Column, model: Model) -> Column:
    """The model's score of a text column (null: empty), 0 to 1."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = model.scorer()
        for texts in batches:
            found: list[float] = []
            for at in range(0, len(texts), 512):
                found.extend(float(one(t)) for t in texts.slice(at, 512).to_pylist())
            yield pa.array(found, pa.float64())

    return of(F.coalesce(text, F.lit("")))


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, score, predicted`` of every row: one narrow pass over whole texts.

    Null and empty texts get the score of no evidence; null and repeated ids are kept; other
    columns are not looked at; an empty table gives no rows.
    """
    raw = F.col("score")
    return df.select(F.col(id_col), score(F.col(text_col), model).alias("score")).select(id_col, "score", (raw >= threshold).cast("int").alias("predicted"))


def reject_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``; all columns stay.

    Null and empty texts have no evidence against them and stay, unless the share of toxic
    rows alone reaches ``threshold``; repeated rows stay or go together; an empty table gives
    no rows. A model that was learnt without positives rejects nothing."""
    own = fresh(df, "score")
    return df.withColumn(own, score(F.col(f"`{text_col}`"), model)).where(F.col(own) < threshold).select(*df.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_documents`` of all ``documents``, learnt from rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    found = score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
