"""Searches over whole commit graphs, against brute force."""

import random

import pytest
from oracle import DATA

from grove import catalog
from grove.operators import graph as G
from grove.plans import derive


def levels(parents, head):
    found, front, level = {head: 0}, [head], 0
    while front:
        level += 1
        front = list({p for c in front for p in parents.get(c, ()) if p not in found})
        found |= dict.fromkeys(front, level)
    return found


def lowest(parents, a, b):
    pasts = {x: set(levels(parents, x)) for x in (a, b)}
    common = pasts[a] & pasts[b]
    return {x for x in common if not any(x in parents.get(y, ()) for y in common)}


@pytest.fixture(scope="module")
def graph(spark):
    """Two long chains that part, with merges across them and a root of its own."""
    rng = random.Random(4)
    parents = {c: {c - 2} for c in range(3, 301)} | {2: {1}, 400: {300}}
    for c in rng.sample(range(60, 301), 25):
        parents[c].add(rng.randrange(1, c - 1))
    rows = [(c, p, c) for c, ps in parents.items() for p in ps] + [(1, None, 1), (500, None, 500)]
    return parents, spark.createDataFrame(rows, "commit long, parent long, date long").cache()


def test_history_without_bounds_takes_few_rounds(graph, monkeypatch):
    parents, commits = graph
    settle, calls = G.settle, []
    monkeypatch.setattr(G, "settle", lambda df: calls.append(1) or settle(df))
    found = {r.commit: r.level for r in G.history(commits, 400)[0].collect()}
    assert found == levels(parents, 400)
    assert len(calls) < 45 < max(found.values())


def test_lcas_of_the_whole_graph(spark, graph):
    parents, commits = graph
    rng = random.Random(8)
    pairs = {(rng.randrange(1, 301), rng.randrange(1, 301)) for _ in range(25)} | {(299, 300), (400, 500)}
    out = G.lcas(commits, spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    assert {(r.a, r.b, r.lca) for r in out} == {(a, b, x) for a, b in pairs for x in lowest(parents, a, b)}


def test_registered_queries_walk_all_commits(spark):
    queries = catalog.queries()
    rows = [(r.commit, r.parent) for r in derive.commits(spark, DATA).collect()]
    parents: dict = {}
    for c, p in rows:
        parents.setdefault(c, set()).update([] if p is None else [p])
    head = max(parents)
    assert {r.commit: r.level for r in queries["commit_history_all"](spark, DATA).collect()} == levels(parents, head)
    pairs = [(c, head + 1 - c) for c in parents if c % 50 == 0]
    assert {(r.a, r.b, r.lca) for r in queries["lcas_pairs_all"](spark, DATA).collect()} == {(a, b, x) for a, b in pairs for x in lowest(parents, a, b)}
    want = {(a, b, "no_change" if a == b else "ok" if lowest(parents, a, b) == {a} else "rejected") for a, b in pairs}
    assert {(r["head"], r["target"], r["result"]) for r in queries["fast_forward_all"](spark, DATA).collect()} == want
