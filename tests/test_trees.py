"""Golden cases of trees, diffs and merges."""

import pytest
from pyspark.sql import functions as F

from grove.functions import merges, paths
from grove.operators import merge as M
from grove.operators import trees as T

SCHEMA = "path array<string>, value string, metadata string"


def tree(spark, leaves, metadata="m"):
    return spark.createDataFrame([(p.split("/"), v, metadata) for p, v in leaves.items()], SCHEMA)


def plain(df):
    return {"/".join(r.path): r.value for r in df.collect()}


def keys(spark, *names):
    return spark.createDataFrame([(n.split("/") if n else [],) for n in names], "path array<string>")


def steps(df):
    return [r.step for r in df.collect()]


def test_listing_is_in_order(spark):
    t = tree(spark, {"aa": "0", "ab": "1", "a": "2", "b": "3"})
    assert steps(T.listing(t, [])) == ["a", "aa", "ab", "b"]


@pytest.mark.parametrize(("offset", "length", "expected"), [(0, 2, ["a", "aa"]), (2, 3, ["aaa", "b", "bbb"]), (1, 1, ["aa"]), (4, 2, ["bbb"]), (5, 2, [])])
def test_listing_pages(spark, offset, length, expected):
    t = tree(spark, {"aa": "0", "a": "1", "bbb": "3", "b": "3", "aaa": "2"})
    assert steps(T.listing(t, [], offset, length)) == expected


def test_listing_of_a_leaf_is_empty(spark):
    assert steps(T.listing(tree(spark, {"a": "1"}), ["a"])) == []


def test_diff_added_removed_updated(spark):
    empty, one = tree(spark, {"x": "v"}).limit(0), tree(spark, {"k": "v"})
    kind = lambda x, y: [r.kind for r in M.diff(x, y).collect()]
    assert kind(empty, one) == ["added"]
    assert kind(one, empty) == ["removed"]
    assert kind(tree(spark, {"k": "v"}, "Left"), tree(spark, {"k": "v"}, "Right")) == ["updated"]
    assert kind(one, one) == []


def test_add(spark):
    t = tree(spark, {"a/aa": "0", "a/ab": "ab_v", "b": "3"})
    assert plain(T.add(t, tree(spark, {"a/ab": "new"}))) == {"a/aa": "0", "a/ab": "new", "b": "3"}
    assert plain(T.add(t, tree(spark, {"a/ac/aca": "x"})))["a/ac/aca"] == "x"
    assert plain(T.add(t, tree(spark, {"b": "3"}))) == plain(t)


def test_a_path_is_a_leaf_or_a_directory(spark):
    t = tree(spark, {"fst": "ok"})
    below = T.add(t, tree(spark, {"fst/snd": "maybe?"}))
    assert plain(below) == {"fst/snd": "maybe?"}
    assert plain(T.add(below, t)) == {"fst": "ok"}


def test_remove(spark):
    t = tree(spark, {"a/aa": "0", "a/ab": "1", "b": "3"})
    assert plain(T.remove(t, keys(spark, "a/none"))) == plain(t)
    assert plain(T.remove(t, keys(spark, "a"))) == {"b": "3"}
    assert plain(T.remove(tree(spark, {"a": "1"}), keys(spark, "a"))) == {}


def test_update_prunes_and_replaces(spark):
    t = tree(spark, {"a/b/c": "1", "a_unrelated": "<>"})
    assert plain(T.update(t, keys(spark, "a/b/c"), lambda v: F.lit(None).cast("string"))) == {"a_unrelated": "<>"}
    assert plain(T.update(t, keys(spark, "a/b"), lambda v: F.lit("x"))) == {"a/b": "x", "a_unrelated": "<>"}


def test_stats(spark):
    t = tree(spark, {"a/aa": "v-aa", "a/ab": "v-ab", "a/ac": "v-ac", "b": "v-b", "c": "v-c"})
    assert T.stats(t).first().asDict() == {"nodes": 2, "leafs": 5, "skips": 0, "depth": 2, "width": 3}


def test_kinds_and_folds(spark):
    t = tree(spark, {"c1": "c1", "n1/c1": "x", "n1/n1/c1": "y"})
    kind = {"/".join(r.path): r.kind for r in T.kinds(t, keys(spark, "c1", "n1", "n1/n1", "zz", "")).collect()}
    assert kind == {"c1": "contents", "n1": "node", "n1/n1": "node", "zz": None, "": "node"}
    at = lambda rel, d: sorted("/".join(r.path) for r in T.visits(t, rel, d).collect())
    assert at("lt", 0) == [""]
    assert at("eq", 1) == ["c1", "n1"]
    assert at("ge", 2) == ["n1/c1", "n1/n1", "n1/n1/c1"]


def test_hash_ignores_order_and_sees_changes(spark):
    leaves = {f"d/{i}": str(i) for i in range(50)}
    t = tree(spark, leaves)
    assert T.equal(t, tree(spark, dict(reversed(leaves.items()))).repartition(3))
    assert not T.equal(t, T.add(t, tree(spark, {"d/7": "x"})))


def test_batch_in_order(spark):
    t = tree(spark, {"a": "1", "b/c": "2"})
    ops = spark.createDataFrame([(1, ["a", "x"], "3", "m"), (2, ["b"], None, None), (3, ["b", "d"], "4", "m"), (4, ["e"], "5", "m"), (5, ["e"], None, None)], "seq long, path array<string>, value string, metadata string")
    assert plain(T.apply_batch(t, ops)) == {"a/x": "3", "b/d": "4"}


TABLE = [  # ancestor, ours, theirs, merged value, conflict
    (None, "a", None, "a", None),
    (None, None, "b", "b", None),
    (None, "a", "a", "a", None),
    (None, "a", "b", None, "default"),
    ("o", "o", "o", "o", None),
    ("o", "a", "o", "a", None),
    ("o", "o", "b", "b", None),
    ("o", "a", "a", "a", None),
    ("o", "a", "b", None, "default"),
    ("o", "o", None, None, None),
    ("o", None, "o", None, None),
    ("o", "a", None, None, "option: add/del"),
    ("o", None, "b", None, "option: add/del"),
    ("o", None, None, None, None),
]


def test_merge_table(spark):
    one = lambda i: tree(spark, {f"k{n}": row[i] for n, row in enumerate(TABLE) if row[i] is not None})
    found = {r.path[0]: (r.value, r.conflict) for r in M.commit_mode(one(0), one(1), one(2)).collect()}
    for n, row in enumerate(TABLE):
        assert found.get(f"k{n}", (None, None)) == row[3:], row


def test_merge_of_branches(spark):
    old = tree(spark, {"a/b/a": "X1", "a/b/b": "X2", "a/b/c": "X3"})
    main, test = tree(spark, {"a/b/a": "X1", "a/b/b": "X3", "a/b/c": "X3"}), tree(spark, {"a/b/a": "X1", "a/b/b": "X2", "a/b/c": "X1"})
    assert plain(M.commit_mode(old, main, test)) == {"a/b/a": "X1", "a/b/b": "X3", "a/b/c": "X1"}


def test_unrelated_trees_merge(spark):
    none = tree(spark, {"x": "1"}).limit(0)
    assert plain(M.commit_mode(none, tree(spark, {"a": "X1"}), tree(spark, {"b": "X1"}))) == {"a": "X1", "b": "X1"}


def test_merge_laws(spark):
    o, x = tree(spark, {"a": "1", "b/c": "2"}), tree(spark, {"a": "5", "d": "2"})
    assert plain(M.commit_mode(o, x, o)) == plain(x) == plain(M.commit_mode(o, o, x)) == plain(M.patch(o, M.diff(o, x)))


def test_tree_mode_conflicts(spark):
    o = tree(spark, {"d/a": "1", "d/b": "2", "e": "1"})
    gone, changed = tree(spark, {"e": "1"}), tree(spark, {"d/a": "1", "d/b": "2", "d/c": "3", "e": "1"})
    assert [("/".join(r.path), r.conflict) for r in M.tree_conflicts(o, gone, changed).collect()] == [("d", "option: add/del")]
    leaf, directory = tree(spark, {"e": "1", "n": "1"}), tree(spark, {"e": "1", "n/x": "1"})
    found = {("/".join(r.path), r.conflict) for r in M.tree_conflicts(gone, leaf, directory).collect()}
    assert found == {("n", "add/add values")}


def test_sets_and_counters(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], ["a", "b", "d"], 5, 7, 4)], "o array<string>, a array<string>, b array<string>, x int, y int, z int")
    got = row.select(merges.sets(F.col("o"), F.col("a"), F.col("b")).alias("s"), merges.counter(F.lit(True), F.col("x"), F.col("y"), F.col("z"))["value"].alias("n")).first()
    assert got.s == ["b", "c", "d"]
    assert got.n == 6


def test_paths(spark):
    row = spark.range(1).select(paths.show(paths.parse(F.lit("//a//b/"))).alias("p"), paths.show(paths.parse(F.lit(""))).alias("root"), paths.valid_branch(F.lit("bar/toto")).alias("good"), paths.valid_branch(F.lit("a b")).alias("bad")).first()
    assert row.asDict() == {"p": "/a/b", "root": "/", "good": True, "bad": False}
