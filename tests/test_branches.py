"""Branches, merges and synchronisation of small repositories; golden cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from grove.functions import hashes, merges, paths
from grove.operators import commits as C
from grove.operators import graph as G
from grove.operators import json_trees as J
from grove.operators import merge as M
from grove.operators import objects as O
from grove.operators import proofs as P
from grove.operators import trees as T
from grove.sources import repository as R
from grove.sources import sync

INFO = (0, "TESTS", "")


@pytest.fixture
def repo(spark, tmp_path):
    return R.Repository(spark, str(tmp_path / uuid.uuid4().hex))


def tree(spark, leaves: dict):
    return spark.createDataFrame([(k.strip("/").split("/") if k else [], v, None) for k, v in leaves.items()], "path array<string>, value string, metadata string")


def shown(df):
    return {"/".join(r.path): r.value for r in df.collect()}


def test_merge_of_branches_that_changed_different_keys(spark, repo):
    """main sets b twice, test sets c; main gets both, test stays as it is."""
    repo.update("main", [], lambda _: tree(spark, {"a/b/a": "X1", "a/b/b": "X2", "a/b/c": "X3"}), *INFO)
    repo.clone("main", "test")
    for value in ("X1", "X3"):
        repo.set("main", ["a", "b", "b"], value, *INFO)
    repo.set("test", ["a", "b", "c"], "X1", *INFO)
    repo.merge_branch("main", "test", *INFO)
    assert shown(repo.checkout(repo.head("main"))) == {"a/b/a": "X1", "a/b/b": "X3", "a/b/c": "X1"}
    assert shown(repo.checkout(repo.head("test")))["a/b/b"] == "X2"
    merged = repo.info(repo.head("main"))
    assert len(merged.parents) == 2
    # A merge of what is in the past already changes nothing; a branch behind moves up.
    assert repo.merge_branch("main", "test", *INFO) == repo.head("main")
    assert repo.merge_branch("test", "main", *INFO) == repo.head("main")
    assert repo.fast_forward("test", repo.head("main")) == "no_change"
    assert repo.lcas("main", "test") == [repo.head("main")]


def test_merge_without_a_common_ancestor_and_a_clash(spark, repo):
    repo.set("foo", ["a"], "X1", *INFO)
    repo.set("bar", ["b"], "X1", 1, "TESTS", "")
    repo.merge_branch("foo", "bar", *INFO)
    assert shown(repo.checkout(repo.head("foo"))) == {"a": "X1", "b": "X1"}
    repo.set("clash", ["a"], "X2", 2, "TESTS", "")
    before = repo.head("foo")
    with pytest.raises(C.MergeConflict, match="Recursive merging of common ancestors: default"):
        repo.merge_branch("foo", "clash", *INFO)
    assert repo.head("foo") == before
    with pytest.raises(ValueError, match="not a valid branch"):
        repo.merge_branch("foo", "nobody", *INFO)


@pytest.mark.parametrize(("strategy", "end"), [("set", "1,2"), ("test_and_set", "1,4"), ("merge", "1,4")])
def test_with_tree_against_another_writer(spark, repo, strategy, end):
    """Both start from nothing; the other writes first. Set writes over it, the others see it."""
    seen = []

    def change(old):
        value = None if old is None else shown(old).get("")
        seen.append(value)
        if len(seen) == 1:
            repo.set("main", ["a"], "1", 1, "TESTS", "other")
        return tree(spark, {"": "1,2" if value is None else "1,4"})

    repo.with_tree("main", ["a"], change, *INFO, strategy=strategy)
    assert shown(repo.checkout(repo.head("main"))) == {"a": end}
    assert seen == ([None] if strategy == "set" else [None, "1"])


def test_test_and_set_of_subtrees(spark, repo):
    leaf = lambda v: tree(spark, {"": v})
    assert repo.test_set_and_get("main", ["k"], None, leaf("v1"), *INFO) is not None
    assert repo.test_set_and_get("main", ["k"], leaf("v1"), leaf("v1"), *INFO) is None
    with pytest.raises(R.TestWas) as was:
        repo.test_set_and_get("main", ["k"], None, leaf("v2"), *INFO)
    assert shown(was.value.tree) == {"": "v1"}
    head = repo.head("main")
    assert repo.set("main", ["k"], "v1", *INFO) is None and repo.head("main") == head
    assert repo.set("main", ["k"], "v1", *INFO, allow_empty=True) != head
    assert repo.remove("main", ["k"], *INFO) is not None
    assert repo.checkout(repo.head("main")).isEmpty()
    with pytest.raises(ValueError, match="root"):
        repo.set("main", [], "alone", *INFO)


def test_branch_versions(spark, repo):
    repo.set("main", ["a"], "1", *INFO)
    repo.clone("main", "bar/toto")
    assert repo.branches() == {"main": repo.head("main"), "bar/toto": repo.head("main")}
    repo.clone("nobody", "bar/toto")
    assert list(repo.branches()) == ["main"]
    with pytest.raises(ValueError, match="invalid branch"):
        repo.set_head("no good", repo.head("main"))
    # A version that is not written in full is not there yet, and nobody moves the branch.
    fs, path = repo._fs("main/1")
    fs.create(path, False).close()
    assert repo.head("main") is not None and not repo.test_and_set("main", repo.head("main"), None)
    with pytest.raises(R.TooManyRetries):
        repo.set_head("main", None)


def test_sync_and_damage(spark, repo, tmp_path):
    repo.update("main", [], lambda _: tree(spark, {"a/b": "1", "c": "2"}), *INFO)
    other = R.Repository(spark, str(tmp_path / "other"))
    assert sync.fetch(other, repo, "nobody") is None
    assert sync.pull(other, repo, "main") == repo.head("main") == other.head("main")
    other.set("main", ["c"], "3", 1, "TESTS", "")
    assert sync.push(other, repo, "main") == repo.head("main")
    assert shown(repo.checkout(repo.head("main"))) == {"a/b": "1", "c": "3"}
    repo.set("main", ["d"], "4", 2, "TESTS", "")
    other.set("main", ["e"], "5", 3, "TESTS", "")
    sync.pull(other, repo, "main", info=INFO)
    assert shown(other.checkout(other.head("main"))) == {"a/b": "1", "c": "3", "d": "4", "e": "5"}
    with pytest.raises(ValueError, match="no head"):
        sync.push(other, repo, "nobody")
    assert other.integrity().isEmpty()
    part = repo.export()
    bad = {**part, "nodes": part["nodes"].withColumn("step", F.concat("step", F.lit("!")))}
    with pytest.raises(Exception, match="corrupted slice node"):
        R.Repository(spark, str(tmp_path / "bad")).load(bad)
    hole = R.Repository(spark, str(tmp_path / "hole"))
    hole.load({**part, "contents": part["contents"].where("value <> '1'")})
    assert [(r.kind, r.problem) for r in hole.integrity([repo.head("main")]).collect()] == [("contents", "missing")]
    with pytest.raises(Exception, match="dangling contents"):
        hole.checkout(repo.head("main"))
    shallow = repo.export([repo.head("main")], depth=0)
    assert shallow["commits"].count() == 1 and repo.export(full=False)["contents"].isEmpty()


# Commits with their parents, and which keys each one writes.
LINE = {0: [], 1: [0], 2: [1], 3: [2], 4: [3]}
CROSS = {**LINE, 10: [4], 11: [10], 12: [10], 13: [11], 14: [12], 15: [12, 13], 16: [14], 17: [11, 16]}
WRITES = {0: ["k0", "k1"], 1: ["k1"], 2: ["k0"], 3: ["k0", "k1"], 4: ["k1"]}


def test_last_modified_on_a_line(spark):
    commits = spark.createDataFrame([(c, p, c) for c, ps in LINE.items() for p in ps or [None]], "commit long, parent long, date long")
    values = {k: {} for k in ("k0", "k1", "k2")}
    for c in LINE:
        for k in values:
            if k in WRITES[c]:
                values[k][c] = f"{k}-{c}"
            elif c and c - 1 in values[k]:
                values[k][c] = values[k][c - 1]
    table = {k: spark.createDataFrame(list(v.items()), "commit long, value string") for k, v in values.items()}
    at = lambda key, **more: G.first_changes(commits, table[key], 4, **more)
    assert [at("k0", n=n) for n in (1, 2, 3)] == [[3], [2, 3], [0, 2, 3]]
    assert at("k0", n=3, depth=1) == [3] and at("k0", n=2, depth=0) == [] == at("k2")


def test_ancestors_that_are_merged(spark):
    """15 and 17 have two lowest common ancestors, 11 and 12."""
    commits = spark.createDataFrame([(c, p) for c, ps in CROSS.items() for p in ps or [None]], "commit long, parent long")
    leaves = {c: {"x": "0"} for c in CROSS} | {c: {"x": "0", "n": "11"} for c in (11, 13)} | {c: {"x": "0", "m": "12"} for c in (12, 14, 16)}
    leaves |= {15: {"x": "15", "n": "11", "m": "12"}, 17: {"x": "0", "n": "17", "m": "12"}}
    known = C.Virtual(commits, lambda c: tree(spark, leaves[c]))
    made = C.three_way(known, 15, 17)
    assert shown(known.tree(made)) == {"x": "15", "n": "17", "m": "12"}
    assert C.three_way(known, 3, 4) == 4 and C.three_way(known, 4, 2) == 4 and C.three_way(known, 4, 4) == 4
    assert C.lca(known, [13, 14, 4]) == 4
    with pytest.raises(C.MergeConflict, match="empty"):
        C.lca(known, [])
    with pytest.raises(C.MergeConflict, match="Max depth"):
        C.lca(known, [3, 4], max_depth=0)


def test_tree_mode(spark):
    t = lambda leaves: tree(spark, leaves)
    assert shown(M.tree_mode(t({"a/b": "1", "c": "2"}), t({"a/b": "1", "c": "3"}), t({"a/b": "4", "c": "2"}))) == {"a/b": "4", "c": "3"}
    with pytest.raises(C.MergeConflict, match="empty map"):
        M.tree_mode(t({"a": "1", "b": "1"}), t({"a": "1"}), t({"b": "1"}))
    with pytest.raises(C.MergeConflict, match="add/del"):
        M.tree_mode(t({"a/b": "1", "c": "1"}), t({"c": "1"}), t({"a/b": "2", "c": "1"}))


def test_json_merges(spark):
    """Null is a value, absence is not; true is no number; arrays and objects as wholes."""
    cases = [
        ('{"k":1}', '{"k":null}', '{"k":1,"j":2}', '{"j": 2, "k": null}'),
        ('{"a":1}', '{"a":1,"n":null}', '{"a":2}', '{"a": 2, "n": null}'),
        ("0", "false", "1", "Conflicting JSON datatypes"),
        ("[1]", "[1,2]", "[1,2]", "[1, 2]"),
        ('{"a":1}', '{"a":2}', "{}", "option: add/del"),
        ('{"a":{"b":1}}', '{"a":{"b":2}}', '{"a":{"b":1,"c":3}}', '{"a": {"b": 2, "c": 3}}'),
        (None, "1", "1", "default: add/add and no common ancestor"),
        ("null", "null", "2", "2"),
        ("1", "2", "3", "default"),
        (None, None, "[]", "[]"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, o string, a string, b string")
    found = {r.i: r.m for r in df.select("i", J.merge_json(F.col("o"), F.col("a"), F.col("b")).alias("m")).collect()}
    for i, case in enumerate(cases):
        assert (found[i].value if found[i].ok else found[i].conflict) == case[3], case


def test_digests(spark):
    """Fixed vectors of the digests; the short hash is the first eight bytes, least first,
    without the highest bit."""
    row = spark.range(1).select(F.lit("abc").alias("v")).select(
        hashes.digest(F.col("v"), "blake2b").alias("b"), hashes.digest(F.col("v"), "blake2s").alias("s"), hashes.digest(F.col("v"), "ripemd160").alias("r"),
        hashes.digest(F.col("v"), "blake2b", 20).alias("b20"), hashes.short(F.sha1("v")).alias("short"), hashes.short(F.lit("ffffffffffffffff")).alias("all"), hashes.short(F.lit("0000000000000040")).alias("sign"),
    ).first()
    assert row.b.startswith("ba80a53f981c4d0d6a2797b69f12f6e9") and row.s == "508c5e8c327c14e2e1a72ba34eeb452f37458b209ed63a294d999b4c86675982"
    assert row.r == "8eb208f7e05d987a9b044a8e98c6b087f15a0bfc" and len(row.b20) == 40
    whole = int.from_bytes(bytes.fromhex("a9993e364706816a"), "little") & (2**63 - 1)
    assert row.short == (whole - 2**63 if whole >= 2**62 else whole)
    assert row["all"] == -1 and row.sign == -(2**62)


def test_pruned_trees_and_proofs(spark):
    whole = tree(spark, {"foo/a": "1", "foo/b/c": "2", "bar/d": "3", "e": "4"})
    keys = spark.createDataFrame([(["foo"],)], "path array<string>")
    left, cut = T.prune(whole, keys)
    ask = lambda *p: T.find_pruned(left, cut, spark.createDataFrame([(list(p),)], "path array<string>")).collect()
    assert ask("e")[0].value == "4" and ask("none")[0].value is None
    with pytest.raises(Exception, match="pruned hash"):
        ask("foo", "a")
    proof = P.prove(whole, spark.createDataFrame([(["e"],)], "path array<string>"))
    before = P.root(proof)
    after = P.root(P.prove(tree(spark, {"foo/a": "1", "foo/b/c": "2", "bar/d": "3", "e": "5"}), keys))
    five = lambda t: t.withColumn("value", F.lit("5"))
    assert shown(P.run(proof, before, five, after)) == {"e": "5"}
    with pytest.raises(P.ProofMismatch, match="result"):
        P.run(proof, before, lambda t: t, after)
    with pytest.raises(P.ProofMismatch, match="another tree"):
        P.run(proof, after, five, after)
    with pytest.raises(P.ProofMismatch, match="hash alone"):
        P.run(proof, before, lambda t: t.unionByName(tree(spark, {"foo/a": "9"})), after)


def test_small_rules(spark):
    assert not O.assemble(O.chunk(spark.createDataFrame([("a\0",), ("",), ("abcdef",)], "value string"), 4, pad=True)).where("not intact").count()
    ends = O.coalesce_ranges(spark.createDataFrame([(5, 20), (25, 3), (40, 1), (7, 2), (60, 0)], "off long, len long"), 8)
    assert sorted((r.off, r.len) for r in ends.collect()) == [(5, 23), (40, 1)]
    assert spark.range(1).select(paths.no_info(paths.info())).first()[0]
    lost = merges.counter(F.lit(True), F.lit(0).cast("long"), F.lit(2**63 - 1).cast("long"), F.lit(1).cast("long"))
    assert spark.range(1).select(lost["value"]).first()[0] == -(2**63)
