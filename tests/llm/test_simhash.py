import random

import numpy as np
import pytest
import xxhash

from grove.llm import simhash as S
from grove.llm.components import components


def plain(text, words):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near(seed, n):
    """Fingerprints in families: chains and clusters around shared ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 8))))
    return out


@pytest.mark.parametrize(("bits", "large", "split"), [(4, 512, 1 << 15), (4, 2, 8), (7, 512, 1 << 15), (0, 512, 1 << 15)])
def test_links_lose_no_pair(spark, monkeypatch, bits, large, split):
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "SPLIT", split)
    fps = sorted(set(near(bits, 300)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = S.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits)
    found = {r.node: r.root for r in components(links).collect()}
    want = groups(fps, bits)
    got = [found.get(x, x) for x in signed]
    pairs = lambda g: {(i, j) for i in range(len(g)) for j in range(i) if g[i] == g[j]}
    assert pairs(got) == pairs(want)


def test_every_plan_shares_a_key():
    for bits in (0, 1, 4, 7):
        for n in (10, 10**6, 10**11):
            blocks, agree = S.plan(n, bits)
            assert blocks - bits >= agree >= 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == dict.fromkeys(range(201), 0) | {1000: 1000, 1001: 1000}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) for _ in range(150)] + [None, "", "\x0b \x1c"]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    fps = [plain(t, 4) for t in texts]
    want = groups(fps, 4)
    for i, f in enumerate(fps):
        assert rows[i * 3].fingerprint == f"{f:016x}"
        assert rows[i * 3].component_id == want[i] * 3


def test_odd_tables(odd, none):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert {c for (i, f), c in by.items() if f == "0" * 16} == {2}  # null, empty and blank texts are one group
    assert S.near_duplicates(none).count() == 0 == S.keep_one(none).count()
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7]


def test_rows_without_an_id(spark):
    same = "one two three four five six seven"
    df = spark.createDataFrame([(None, same), (None, same), (None, "other words that stand alone here now"), (8, same), (8, same)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[:3]) for r in S.keep_one(df).collect()) == [(0, "oth"), (8, "one")]


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = " ".join(str(i) for i in range(500)).encode()
    whole = S.simhash(text, 4)
    monkeypatch.setattr(S, "SLICE", 7)
    assert S.simhash(text, 4) == whole == plain(text.decode(), 4)
    assert np.bitwise_count(np.uint64(whole)) <= 64
