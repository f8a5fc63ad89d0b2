"""WARC round trips, the language model against plain Python, and the pipeline."""

import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict

import pytest
from oracle import DATA, rows, sql
from pyspark.sql import functions as F

from grove.llm import kneser_ney as K
from grove.llm import queries as Q
from grove.llm import warc as W
from grove.llm.shared import work_dir

PAGES = [(5, "http://a/", "x" * 200), (3, "http://b/\r\nX: y", "x" * 200), (9, None, "x" * 200), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", "é" * 90), (None, "u", "é" * 90), (7, "u", "\x1f\x8b\x08 not a member " * 40), (8, "u", "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000)))]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("z")).withColumn("id", F.lit(0))


@pytest.mark.parametrize(("split", "small"), [(1, 10), (777, 10), (1 << 20, 0)])
def test_round_trip_at_any_split(spark, monkeypatch, split, small):
    monkeypatch.setattr(W, "SMALL", small)
    archives = W.write_archives(pages(spark).repartition(3), f"{work_dir(spark)}/warc-{split}")
    if split == 1:
        split = 97
    found = W.read_archives(archives, split).collect()
    assert len(found) == len(PAGES) and all(r.valid for r in found)
    by = {r.page_id: r for r in found}
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(data) >= 100 and first != i
        assert by[i].record_type == ("revisit" if revisit else "response")
        assert by[i].refers_to == (first if revisit else None)
        assert by[i].payload == (None if revisit else data)
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())


def test_false_members_and_padding():
    junk = b"junk" + W.MAGIC + b"zz" + gzip.compress(b"no warc") + W.record(1, "u", b"x" * 50, "d", None, "t") + W.MAGIC + W.record(2, None, b"", "d", 1, "t") + b"\0" * 10
    for split in (1, 5, 64, 1 << 20):
        found = [h["x-page-id"] for at in range(0, len(junk), split) for h, _ in W.records(io.BytesIO(junk), at, at + split)]
        assert found == ["1", "2"]


def test_empty_pages(spark):
    archives = W.write_archives(pages(spark).limit(0), f"{work_dir(spark)}/warc-none")
    assert W.read_archives(archives).count() == 0


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney, by the book."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = b"\0" * (order - 1) + t
        counts[order].update(b[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in range(5)]
        if not (n[1] and n[2] and n[3]):
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))

    ds = [None] + [discounts(c) for c in counts[1:]]
    totals, taken = [defaultdict(int) for _ in counts], [defaultdict(float) for _ in counts]
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            totals[k][g[:-1]] += n
            taken[k][g[:-1]] += ds[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / 256
        h = g[:-1]
        if h not in totals[k]:
            return lower
        n = counts[k].get(g, 0)
        return (n - ds[k][min(n, 3) - 1] if n else 0) / totals[k][h] + taken[k][h] / totals[k][h] * lower

    return p


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "élan"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]


def test_model_against_plain_python(spark, corpus, monkeypatch):
    monkeypatch.setattr(K, "BATCH", 500)
    order = 4
    p = plain_model([t.encode() for t in corpus], order)
    asked = [*corpus[:10], "zebra quiz", "the mat", "", None, "É\x00\x01"]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    model = K.train(spark.createDataFrame([(t,) for t in corpus], "text string"), order)
    for r in K.perplexities(docs, model).collect():
        t = (asked[r.doc_id] or "").encode()
        padded = b"\0" * (order - 1) + t
        logs = [math.log(p(padded[i : i + order])) for i in range(len(t))]
        assert r.n_bytes == len(t)
        assert r.perplexity == (pytest.approx(math.exp(-sum(logs) / len(t)), rel=1e-9) if t else None)
    context = b"the"
    assert sum(p(context + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_quality_by_language(spark, corpus, odd, none):
    rows = [(i, t, "xx" if i % 2 else None) for i, t in enumerate(corpus)] + [(100, "#@!%^&*" * 20, "xx"), (101, corpus[0], "new"), (102, "#@!" * 30, None), (103, "", "xx"), (104, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("batch", F.lit(1)).withColumn("keep", F.lit(1))
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,)], "doc_id long")
    found = {r.doc_id: r for r in K.quality(docs, trusted).collect()}
    assert len(found) == len(rows)
    assert sum(found[i].keep for i in range(60)) >= 57
    assert not any(found[i].keep for i in (100, 102, 103, 104)) and found[101].keep and found[101].threshold is None
    assert len(K.quality(odd, trusted).collect()) == odd.count()
    assert K.quality(none, trusted).count() == 0


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    columns, found = rows(Q.queries()[name](spark, DATA))
    if name in Q.oracle_sql():
        assert (columns, found) == sql(Q.oracle_sql()[name])
    else:
        assert sum(found.values()) > 0


def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    base = source.where("length(text) > 2000 and lang = 'en'").orderBy("doc_id").first()
    words = base.text.split(" ")
    words[len(words) // 2] = "different"
    planted = spark.createDataFrame([(10_001, base.text, "en", "s", 1), (10_002, " ".join(words), "en", "s", 1), (10_003, "Before it. " + items[0].upper() + " After it.", "en", "s", 1), (10_004, "plain text with token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" inside", "en", "s", 1), (10_005, None, None, None, None), (10_006, "idiot trash moron pathetic scum loser clown worthless", "en", "s", 1)], source.schema)
    docs, seen = source.unionByName(planted), []
    for name, stage in C.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == source.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert 10_006 not in seen[0] and {10_001, 10_002, 10_003, 10_004, 10_005} <= seen[0]
    assert not {10_001, 10_002} & seen[1]
    assert 10_003 in seen[1] and 10_003 not in seen[2]
    clean = spark.read.parquet(str(tmp_path / "secret_scan")).where("doc_id = 10004").first()
    assert clean.text == 'plain text with [SECRET]" inside' and clean.n_chars == len(clean.text)
    assert seen[2] == seen[3] == seen[4]
    for frame in (odd.withColumn("n_chars", F.lit(1).cast("long")), none.withColumn("n_chars", F.lit(1).cast("long"))):
        for _, stage in C.STAGES:
            frame = stage(spark, frame, DATA)
        assert frame.count() >= 0
    assert C.run(spark, DATA).count() > 0
