import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grove.llm import kneser_ney as K
from grove.llm.shared import materialize


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "home", "again"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(5, 40)), "xx") for i in range(200)] + [(1000, "#@!%^&*" * 20, "new"), (1001, text(30), "new"), (1002, "zq" * 40, "rare"), (1003, text(30), "rare"), (1004, "", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in [*range(200), 1003]], "doc_id long")
    found = {few: {r.doc_id: r for r in K.quality(docs, trusted, few=few).collect()} for few in (10, 1000)}
    aside = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(K.FOLDS)) == 0).collect()}
    return found, aside


def test_the_threshold_is_the_quantile_itself(scored):
    found, aside = scored
    rows = found[10]
    held = sorted(rows[i].perplexity for i in aside if i < 200)
    assert rows[0].threshold == max(held)  # of under 100 texts the 0.99 quantile is the greatest
    assert all(r.keep == (r.perplexity <= max(held)) for i, r in rows.items() if i < 200)


def test_languages_without_trusted_texts_are_held_to_all(scored):
    found, _ = scored
    for rows in found.values():
        assert not rows[1000].keep and not rows[1002].keep and not rows[1004].keep and rows[1001].keep
        assert rows[1000].threshold is None and rows[1002].threshold is None
    assert found[1000][0].threshold is None
    assert {i for i, r in found[10].items() if r.keep} == {i for i, r in found[1000].items() if r.keep}


def shuffled(spark):
    """Bytes that all stages so far have written by shuffle."""
    sc = spark.sparkContext
    context, gateway = sc._jsc.sc(), sc._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_texts_are_shuffled_once_and_compressed(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("acgt", k=2000)) for _ in range(2000)]
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "docs")
    model = K.train(docs.select("text"), 2)
    before = shuffled(spark)
    assert K.perplexities(docs, model, keep=()).where("perplexity > 1").count() == len(texts)
    assert shuffled(spark) - before < 0.45 * sum(map(len, texts))  # two bits of eight say it all


def test_packed_texts_come_back(monkeypatch):
    texts = ["", "é" * 50, None, "a", "x" * 5000, "", "漢字", "tail " * 30] * 3
    ids, langs = [None if i % 5 == 0 else f"id{i}" for i in range(len(texts))], [None if i % 2 else "xx" for i in range(len(texts))]
    numbers = [i % 3 for i in range(len(texts))]
    part = pa.record_batch([pa.array(numbers), pa.array(texts, pa.string()), pa.array(ids), pa.array(langs)], names=["batch", "text", "c0", "c1"])
    want = sorted(((n, i, lang, t or "") for n, t, i, lang in zip(numbers, texts, ids, langs, strict=True)), key=repr)
    for limit, slice_ in ((1, 1), (300, 100), (1 << 20, 1 << 20)):
        monkeypatch.setattr(K, "PACK", limit)
        monkeypatch.setattr(K, "SLICE", slice_)
        found = []
        for rows in K.pack(iter([part.slice(0, 7), part.slice(7, 0), part.slice(7)]), ["batch", "size", "packed", "c0", "c1"]):
            back = [bytes(data[a:b]).decode() for data, offsets in K.unpack(rows) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            numbered = [n for n, own in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for _ in own]
            found += zip(numbered, *(rows.column(c).flatten().to_pylist() for c in (3, 4)), back, strict=True)
        assert sorted(found, key=repr) == want


def test_perplexities_do_not_depend_on_the_packing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 50, "".join(rng.choices("abc é", k=rng.randrange(0, 300))), i) for i in range(200)] + [(None, None, 7), (None, "", 8), (3, "a" * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, packed int").repartition(3)
    model = K.train(docs.select("text").limit(100), 3)
    found = []
    for batch, limit, slice_ in ((32 << 20, 32 << 20, 1 << 20), (4000, 500, 200), (1, 1, 1)):
        monkeypatch.setattr(K, "BATCH", batch)
        monkeypatch.setattr(K, "PACK", limit)
        monkeypatch.setattr(K, "SLICE", slice_)
        scored = K.perplexities(docs, model, keep=("packed",))
        assert [(f.name, f.dataType.simpleString()) for f in scored.schema] == [("doc_id", "int"), ("packed", "int"), ("n_bytes", "bigint"), ("perplexity", "double")]
        found.append(sorted(((r.doc_id, r.packed, r.n_bytes, r.perplexity and round(r.perplexity, 7)) for r in scored.collect()), key=repr))
    assert found[0] == found[1] == found[2]
    assert [x[:3] for x in found[0]] == [x[:3] for x in sorted(((i, p, len((t or "").encode()), None) for i, t, p in rows), key=repr)]
