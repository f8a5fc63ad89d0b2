"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import runs, utf8
from .shared import table

UNITS = 8  # of each direction
SPAN = 128  # bytes over which state is carried; a text is read span by span
ROWS = 400  # training rows by language
LANGUAGES = 256  # languages that are learnt: those of most rows
WINDOW = 400  # characters of a training row, from a place that its id's hash gives
SLICE = 1 << 20  # bytes that are read in step


class Network:
    """Two gated recurrent layers, one from each side, and a softmax at every byte.

    State is carried over a span of bytes and starts anew with the next: ``SPAN`` bytes where
    texts are read, ``span`` of ``train`` where it learns."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng, h, k = np.random.default_rng(seed), UNITS, len(languages)
        self.languages = languages
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)  # by byte: update, reset, candidate
            self.p[f"u{side}"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
        self.p["o"] = rng.normal(0, h**-0.5, (2 * h, k)).astype(np.float32)
        self.p["c"] = np.zeros(k, np.float32)

    def _layer(self, side: str, steps: np.ndarray, alive: np.ndarray, keep: bool):
        """States at every byte; ``steps`` (time, rows) in reading order. Where a row has no
        byte its state is zero."""
        h, (times, rows) = UNITS, steps.shape
        x, u = self.p[f"x{side}"], self.p[f"u{side}"]
        # sigmoid(a) = (1 + tanh(a / 2)) / 2, so the gates are halved once, in the weights.
        x2, u2 = x.copy(), u.copy()
        x2[:, : 2 * h] *= 0.5
        u2[:, : 2 * h] *= 0.5
        states = np.zeros((times + 1, rows, h), np.float32)
        trace = []
        for t in range(times):
            before = states[t]
            a, r = x2[steps[t]], before @ u2
            gates = np.tanh(a[:, : 2 * h] + r[:, : 2 * h]) * np.float32(0.5) + np.float32(0.5)
            z, reset = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h :] + reset * r[:, 2 * h :])
            now = n + z * (before - n)
            now *= alive[t][:, None]
            states[t + 1] = now
            if keep:
                trace.append((z, reset, n, r[:, 2 * h :]))
        return states, trace

    def forward(self, steps: np.ndarray, alive: np.ndarray, keep: bool = False):
        """Probabilities (time, rows, languages), and what training needs."""
        f, tf = self._layer("f", steps, alive, keep)
        b, tb = self._layer("b", steps[::-1], alive[::-1], keep)
        both = np.concatenate([f[1:], b[1:][::-1]], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, (both, f, tf, b, tb)

    def _through_time(self, side: str, steps: np.ndarray, alive: np.ndarray, states: np.ndarray, trace: list, grad: np.ndarray, g: dict) -> None:
        h, u = UNITS, self.p[f"u{side}"]
        gx, gu, later = np.zeros_like(self.p[f"x{side}"]), np.zeros_like(u), np.zeros_like(states[0])
        for t in range(len(steps) - 1, -1, -1):
            z, reset, n, inner = trace[t]
            before = states[t]
            d = (grad[t] + later) * alive[t][:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * inner * reset * (1 - reset)
            at_u = np.concatenate([dz, dr, dn * reset], axis=1)
            later = d * z + at_u @ u.T
            gu += before.T @ at_u
            np.add.at(gx, steps[t], np.concatenate([dz, dr, dn], axis=1))
        g[f"x{side}"], g[f"u{side}"] = gx, gu

    def gradients(self, steps: np.ndarray, alive: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all bytes, each labelled with its text's language, and its
        gradients by backpropagation through time."""
        probs, (both, f, tf, b, tb) = self.forward(steps, alive, keep=True)
        total = alive.sum()
        rows = np.arange(steps.shape[1])
        loss = -float((np.log(probs[:, rows, target] + 1e-9) * alive).sum() / total)
        d = probs.copy()
        d[:, rows, target] -= 1
        d *= (alive / total)[:, :, None]
        g = {"o": np.einsum("tbh,tbk->hk", both, d), "c": d.sum(axis=(0, 1))}
        back = d @ self.p["o"].T
        self._through_time("f", steps, alive, f, tf, back[:, :, :UNITS], g)
        self._through_time("b", steps[::-1], alive[::-1], b, tb, back[::-1, :, UNITS:], g)
        return loss, g

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probability over all bytes of each text (rows: texts)."""
        sizes = np.diff(offsets)
        spans = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(sizes)), spans)
        first = np.cumsum(spans) - spans
        start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * SPAN
        length = np.minimum(SPAN, offsets[1:][owner] - start)
        time = np.arange(SPAN)
        alive = time[:, None] < length[None, :]
        place = np.minimum(start[None, :] + time[:, None], max(len(data) - 1, 0))
        steps = np.where(alive, data[place], 0) if len(data) else np.zeros((SPAN, 0), np.uint8)
        probs, _ = self.forward(steps, alive.astype(np.float32))
        sums = (probs * alive[:, :, None]).sum(axis=0)
        out = np.zeros((len(sizes), len(self.languages)))
        np.add.at(out, owner, sums)
        return out / np.maximum(sizes, 1)[:, None]


def train(texts: list[tuple[str, str]], epochs: int = 6, batch: int = 256, span: int = 96, rate: float = 0.02, seed: int = 5) -> Network | None:
    """``(language, text)`` to a network; None if there is no text."""
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    pieces, target = [], []
    for lang, text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        for at in range(0, len(raw), span):
            pieces.append(raw[at : at + span])
            target.append(languages.index(lang))
    target = np.array(target)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            steps, alive = np.zeros((span, len(chosen)), np.uint8), np.zeros((span, len(chosen)), np.float32)
            for j, i in enumerate(chosen):
                steps[: len(pieces[i]), j], alive[: len(pieces[i]), j] = pieces[i], 1
            _, g = net.gradients(steps, alive, target[chosen])
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(id_col: Column) -> Column:
    """Rows from which nothing is learnt."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on about ``ROWS`` rows of each of ``LANGUAGES`` languages, chosen by a hash of the
    id among those that are not held out and have a text and a language; of each at most
    ``WINDOW`` characters. What comes to the driver is bounded by these three."""
    rows = documents.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    shares = {r[lang_col]: min(1.0, ROWS / r["count"]) for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()}
    if not shares:
        return None
    hashed = F.xxhash64(F.col(id_col))
    chosen = reduce(lambda a, b: a | b, [(F.col(lang_col) == lang) & (F.shiftright(hashed, 33) + 2**30 <= int(share * 2**31)) for lang, share in shares.items()])
    text = F.col(text_col)
    at = F.pmod(hashed, F.greatest(F.lit(1), F.length(text) - WINDOW + 1)).cast("int") + 1
    got = rows.where(chosen & (F.length(text) > 0)).select(F.col(lang_col).alias("lang"), F.substring(text, at, F.lit(WINDOW)).alias("part")).collect()
    return train(sorted((r.lang, r.part) for r in got))


def predict_language(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row: one narrow pass over whole texts.

    ``score`` is the mean probability of ``lang_pred`` over all bytes, each read within its
    span of ``SPAN`` bytes. A text that is null or
    has no letter, or any text where there was nothing to learn from, is ``und`` with score
    0. Null and repeated ids are kept; other columns are not looked at.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(len(known), -1), np.zeros(len(known))
            if network is not None:
                for a, b in runs(offsets, SLICE):
                    probs = network.predict(np.frombuffer(raw[offsets[a] : offsets[b]], np.uint8), offsets[a : b + 1] - offsets[a])
                    best[a:b], score[a:b] = probs.argmax(axis=1), probs.max(axis=1)
                best[~known], score[~known] = -1, 0
            names = [*(network.languages if network else []), "und"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(np.clip(score, 0, 1))], names=[f.name for f in schema])

    return df.select(F.col(id_col), F.col(text_col), letters.alias("letters")).mapInArrow(work, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predict_language`` of all ``documents``, learnt from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    return predict_language(documents, fit(documents)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
