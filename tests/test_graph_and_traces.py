"""Golden cases of commit graphs, ranges, moving averages, repositories and watches."""

import pytest
from pyspark.sql import functions as F

from grove.operators import containers as C
from grove.operators import graph as G
from grove.operators import json_trees as J
from grove.operators import objects as O
from grove.operators import proofs as P
from grove.operators import trace as T
from grove.operators import trees
from grove.sources.repository import Repository
from grove.streaming import watch as W

LINE = {0: [], 1: [0], 2: [1], 3: [2], 4: [3]}
CROSS = LINE | {10: [4], 11: [10], 12: [10], 13: [11], 14: [12], 15: [12, 13], 16: [14], 17: [11, 16]}
LOOSE = {10: [], 11: [10], 12: [11], 13: [12], 14: [11, 13], 15: [13, 14], 16: [11]}


def dag(spark, parents):
    return G.settle(spark.createDataFrame([(c, p, c) for c, ps in parents.items() for p in (ps or [None])], "commit long, parent long, date long"))


@pytest.mark.parametrize(
    ("parents", "expected"),
    [
        (LINE, {(3, 4): {3}, (2, 4): {2}, (1, 4): {1}}),
        (CROSS, {(10, 10): {10}, (14, 14): {14}, (10, 11): {10}, (12, 16): {12}, (10, 13): {10}, (13, 14): {10}, (15, 16): {12}, (15, 17): {11, 12}}),
        (LOOSE, {(14, 15): {14}, (13, 15): {13}, (12, 15): {12}, (11, 15): {11}, (15, 16): {11}}),
    ],
)
def test_lowest_common_ancestors(spark, parents, expected):
    pairs = spark.createDataFrame(list(expected), "a long, b long")
    found: dict = {}
    for r in G.lcas(dag(spark, parents), pairs).collect():
        found.setdefault((r.a, r.b), set()).add(r.lca)
    assert found == expected


def test_lca_limits(spark):
    c, pair = dag(spark, CROSS), spark.createDataFrame([(15, 17)], "a long, b long")
    for limits in ({"max_depth": -1}, {"max_depth": 1}, {"n": 0}, {"n": 1}):
        with pytest.raises(G.LcaError):
            G.lcas(c, pair, **limits)


def test_fast_forward(spark):
    moves = spark.createDataFrame([(12, 16), (12, 14), (14, 14), (None, 16)], "head long, target long")
    found = {(r.head, r.target): r.result for r in G.fast_forwards(dag(spark, LOOSE), moves).collect()}
    assert found == {(12, 16): "rejected", (12, 14): "ok", (14, 14): "no_change", (None, 16): "ok"}


def test_history(spark):
    vertices, edges = G.history(dag(spark, LINE), 2)
    assert {r.commit for r in vertices.collect()} == {0, 1, 2}
    assert edges.count() == 2


def test_last_modified(spark):
    wrote = spark.createDataFrame([(0, 0, "k0", "a"), (0, 0, "k1", "a"), (1, 1, "k1", "b"), (2, 2, "k0", "b"), (3, 3, "k0", "c"), (3, 3, "k1", "c"), (4, 4, "k1", "d")], "commit long, date long, key string, value string")
    had = spark.createDataFrame([(1, "k1", "a"), (2, "k0", "a"), (3, "k0", "b"), (3, "k1", "b"), (4, "k1", "c")], "commit long, key string, value string")
    found: dict = {}
    for r in G.last_modified(wrote, had, 3).collect():
        found.setdefault(r.key, []).append(r.commit)
    assert {k: sorted(v) for k, v in found.items()} == {"k0": [0, 2, 3], "k1": [1, 3, 4]}


def test_ranges(spark):
    r = spark.createDataFrame([(90, 10), (80, 5), (70, 10), (87, 1), (60, 5), (50, 5), (65, 2), (55, 5)], "off long, len long")
    for shard in (7, 1 << 20):
        found = O.coalesce_ranges(r, shard)
        assert {(x.off, x.len) for x in found.collect()} == {(90, 10), (87, 1), (70, 15), (50, 17)}
    asks = spark.createDataFrame([(55,), (68,), (100,), (87,)], "x long")
    assert {(x.x, x.off, x.place) for x in O.locate(asks, found, 16).collect()} == {(55, 50, "inside"), (68, 70, "before"), (100, None, "after"), (87, 87, "inside")}


def test_chunks(spark):
    values = O.store(spark.createDataFrame([("x" * 100,), ("",), ("é" * 9,)], "value string"))
    for pad in (False, True):
        back = O.assemble(O.chunk(values, 44, pad=pad)).collect()
        assert {r.value for r in back} == {"x" * 100, "", "é" * 9}
        assert all(r.intact for r in back)


def ema(spark, values, m, **more):
    df = spark.createDataFrame(list(enumerate(map(float, values))), "i long, v double")
    return [r.ema for r in T.ema(df, "i", "v", m, **more).orderBy("i").collect()]


def test_ema(spark):
    assert ema(spark, [1000] * 9999 + [0, 0, 0], 0.5)[-3:] == pytest.approx([500, 250, 125])
    assert ema(spark, [500, 250, 125], 0.0) == [500, 250, 125]
    assert T.momentum(10) ** 10 == pytest.approx(0.5)
    assert T.momentum(0) == 0
    hidden = ema(spark, [1, 1, 1], 0.5, relevant=0.2)
    assert hidden[:2] == [None, None] and hidden[2] == pytest.approx(1)
    xs, ys = [3, 1, 4, 1, 5], [2, 7, 1, 8, 2]
    both = ema(spark, [x + y for x, y in zip(xs, ys)], 0.1)
    assert both == pytest.approx([a + b for a, b in zip(ema(spark, xs, 0.1), ema(spark, ys, 0.1))])


def test_logs_merge_newest_first(spark):
    log = lambda *rows: spark.createDataFrame([("k", t, v) for v, t in rows], "k string, ts long, v string")
    old, ours, theirs = log(("main.1", 1), ("main.2", 2)), log(("main.3", 5)), log(("clone.1", 4))
    rows = C.merge_logs(old, ours, theirs, "k", "ts").orderBy("place").collect()
    assert [r.v for r in rows] == ["main.3", "clone.1", "main.2", "main.1"]
    page = C.read_log(old.unionByName(ours), "k", "ts", spark.createDataFrame([("k", 5)], "k string, cursor long"), 1).collect()
    assert [r.v for r in page] == ["main.2"]


def leaves(spark, rows):
    return spark.createDataFrame([(p.split("/"), v, None) for p, v in rows.items()], "path array<string>, value string, metadata string")


def test_proofs(spark):
    t = leaves(spark, {"foo/a": "1", "foo/b/c": "2", "bar/d": "3", "e": "4"} | {f"dir/{i}": f"BLOB:{i}" for i in range(30)})
    keys = spark.createDataFrame([(["foo", "b", "c"],)], "path array<string>")
    root = trees.node_hashes(t).where(F.size("path") == 0).first().hash
    proof = P.prove(t, keys)
    assert P.verify(proof, root)
    assert {r.step for r in proof.where("not blinded").collect()} == {"foo", "b", "c"}
    assert not P.verify(proof.withColumn("value", F.when(F.col("value").isNotNull(), "forged")), root)


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, 2]}, "d": "x", "e": {}}')], "id int, j string")
    assert {("/".join(r.path), r.value) for r in J.project(df, "id", "j").collect()} == {("a/b", "1"), ("a/c", "[1,2]"), ("d", '"x"')}
    rows = spark.createDataFrame([('{"a":1}', '{"a":1,"b":2}', '{"a":3}'), ('{"a":1}', '{"a":2}', '{"a":3}')], "o string, a string, b string")
    got = rows.select(J.merge_json(F.col("o"), F.col("a"), F.col("b")).alias("m")).select("m.*").collect()
    assert (got[0].ok, got[0].value) == (True, '{"a": 3, "b": 2}')
    assert not got[1].ok


def test_repository(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "r"))
    one, two = leaves(spark, {"a/b": "1", "c": "2"}), leaves(spark, {"a/b": "1", "c": "3", "d/e/f": "4"})
    first = repo.set_tree("main", one, 1, "TESTS", "one")
    assert repo.set_tree("main", one, 2, "TESTS", "same") is None
    second = repo.set_tree("main", two, 3, "TESTS", "two")
    assert repo.head("main") == second != first
    as_dict = lambda t: {"/".join(r.path): r.value for r in t.collect()}
    assert as_dict(repo.checkout(second)) == as_dict(two)
    assert as_dict(repo.checkout(first)) == as_dict(one)
    assert not repo.test_and_set("main", first, first)
    assert repo.test_and_set("clone", None, first) and repo.head("clone") == first
    with pytest.raises(ValueError):
        repo.test_and_set("no way", None, first)
    kept = repo.collect_garbage([first], str(tmp_path / "small"))
    assert as_dict(kept.checkout(first)) == as_dict(one)
    assert kept.table("commits").count() == 1
    copy = Repository(spark, str(tmp_path / "copy"))
    copy.load(repo.export([second]))
    assert as_dict(copy.checkout(second)) == as_dict(two)
    assert copy.table("commits").count() == 2


def test_watch_stream_equals_replay(spark, tmp_path):
    rows = [("m", 1, "a"), ("m", 2, "a"), ("m", 3, "b"), ("m", 4, None), ("x", 5, "q"), ("m", 6, "a")]
    heads = spark.createDataFrame(rows, "branch string, seq long, head string")
    for i, part in enumerate((heads.where("seq <= 2"), heads.where("seq > 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(heads.schema).parquet(str(tmp_path / "in"))
        query = W.watch(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {tuple(r) for r in W.replay(heads).collect()}
    assert {(r[1], r[2]) for r in found} == {(1, "added"), (3, "updated"), (4, "removed"), (5, "added"), (6, "added")}
