import random

import pytest

from grove.llm import jaccard as J
from grove.llm.simhash import hamming_links, keep_one


def plain(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def families(seed, count, lengths):
    """Texts and edits of them, at similarities on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " \t", "one two", "One  two", "one two three"]
    for _ in range(count):
        base = [word() for _ in range(rng.choice(lengths))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            edited = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 20))):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    return texts


def expected(texts, similarity=0.8):
    sets = [plain(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(sets)) if find(i) == i}


@pytest.mark.parametrize("part", [1 << 22, 300])
def test_keep_one_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(J, "PART", part)
    texts = families(3, 60, (20, 40, 80, 200))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in keep_one(df).collect()} == expected(texts)


def test_pairs_that_a_fingerprint_loses(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(124)]  # 120 shingles
        edited = list(base)
        edited[40] = edited[80] = "other"  # 110 of 130 shingles shared: 0.846
        other = list(base)
        for at in range(20, 104, 28):
            other[at] = "else"  # 100 of 140 shared with the base: 0.714
        texts += [" ".join(base), " ".join(edited), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in keep_one(df).collect()} == {i for i in range(120) if i % 3 != 1} == expected(texts)


def test_groups_without_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "end"]
    df = spark.createDataFrame([(None, " ".join(base)), (None, " ".join(near)), (None, "alone here")], "doc_id long, text string")
    assert keep_one(df).count() == 2


def test_fingerprints_find_candidates_without_a_shared_band(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), ""]
    own = J.nodes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 5)
    node = {r.id: r.node for r in own.collect()}
    found = {frozenset(r) for r in J._near_prints(own, lambda fps: hamming_links(fps, 4)).collect() if r.a != r.b}
    assert found == {frozenset([node[0], node[1]])}
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()) == [0, 2, 3]
