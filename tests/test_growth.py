"""Steps whose tasks or shuffles grew faster than the input."""

import uuid

import pytest
from pyspark.sql import functions as F

from grove.operators import graph as G
from grove.operators import objects as O
from grove.operators import trees as T
from grove.sources import repository as R

INFO = (0, "TESTS", "")
LEAVES = {"/a/b/c": "1", "/a/b/d": "2", "/a/e": "3", "/f": "4", "/g/h/i/j": "5"}


def tree(spark, leaves: dict):
    return spark.createDataFrame([(k.strip("/").split("/"), v, None) for k, v in leaves.items()], "path array<string>, value string, metadata string")


def shown(df) -> dict:
    return {"/" + "/".join(r.path): r.value for r in df.collect()}


def test_trees_that_a_repository_wrote_are_not_read_again(spark, tmp_path, monkeypatch):
    repo = R.Repository(spark, str(tmp_path / uuid.uuid4().hex))
    repo.update("main", [], lambda _: tree(spark, LEAVES), *INFO)
    with monkeypatch.context() as patch:
        patch.setattr(repo, "read_tree", lambda root: pytest.fail("read again"))
        repo.set("main", ["a", "e"], "9", *INFO)
        assert repo.set("main", ["a", "e"], "9", *INFO) is None
    want = {**LEAVES, "/a/e": "9"}
    assert shown(repo.checkout(repo.head("main"))) == shown(R.Repository(spark, repo.folder).checkout(repo.head("main"))) == want
    nodes = repo.table("nodes")
    assert nodes.count() == nodes.dropDuplicates(["node_hash", "step"]).count()


@pytest.mark.parametrize("small", [0, 1 << 14])
def test_a_directory_that_is_missing_is_an_error(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(R, "SMALL", small)
    repo = R.Repository(spark, str(tmp_path / uuid.uuid4().hex))
    root = repo.write_tree(tree(spark, LEAVES))
    assert shown(repo.read_tree(root)) == LEAVES
    hole = R.Repository(spark, str(tmp_path / uuid.uuid4().hex))
    hole._append("contents", repo.table("contents"), ["hash"])
    hole._append("nodes", repo.table("nodes").where("step not in ('c', 'd')"), ["node_hash", "step"])
    with pytest.raises(Exception, match="dangling node"):
        hole.read_tree(root)


def test_neighbours_go_down_by_directories(spark):
    found = T.neighbours(tree(spark, LEAVES))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each directory above
    assert {"/" + "/".join(r.path): r.siblings for r in found.collect()} == {"/a/b/c": 4, "/a/b/d": 4, "/a/e": 3, "/f": 2, "/g/h/i/j": 2}


def test_few_operations_meet_at_the_root(spark):
    ops = spark.createDataFrame([(1, ["a", "b"], "x", None), (2, ["a", "b", "c"], None, None)], "seq long, path array<string>, value string, metadata string")
    assert sorted((r.seq, r.up) for r in T._ups(ops).collect()) == [(1, ["a", "b"]), (2, ["a", "b"]), (2, ["a", "b", "c"])]


def test_contents_take_no_part_in_the_search(spark, monkeypatch):
    rows = [("commit", "c", "node", "r"), ("node", "r", "contents", "x"), ("node", "r", "node", "n"), ("node", "n", "contents", "x"), ("node", "n", "contents", "y")]
    seen, real = [], G.reach_far
    monkeypatch.setattr(G, "reach_far", lambda edges, *more: seen.append({r.dst for r in edges.collect()}) or real(edges, *more))
    edges = spark.createDataFrame(rows, "src_kind string, src string, dst_kind string, dst string")
    most = spark.createDataFrame([("commit", "c"), ("contents", "z")], "kind string, key string")
    found = {(r.kind, r.key): r.level for r in G.visits(edges, most).collect()}
    assert found == {("commit", "c"): 0, ("contents", "z"): 0, ("node", "r"): 1, ("node", "n"): 2, ("contents", "x"): 2, ("contents", "y"): 3}
    assert seen == [{"node:r", "node:n"}]


def test_tasks_grow_with_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "TASK", 4)
    ranges = spark.range(40).select((F.col("id") * 10).alias("off"), (F.col("id") % 3 * 5 + 1).alias("len"))
    asked = []
    real = O._dealt
    monkeypatch.setattr(O, "_dealt", lambda rows, count, key: asked.append(real(rows, count, key)) or asked[-1])
    joined = O.coalesce_ranges(ranges, 64)
    assert asked[0].rdd.getNumPartitions() == 10
    covered = sorted((r.off, r.off + r.len) for r in joined.collect())
    want = []
    for i in range(40):
        a, b = i * 10, i * 10 + i % 3 * 5 + 1
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert covered == [tuple(w) for w in want]
    places = O.locate(spark.range(0, 420, 7).select(F.col("id").alias("x")), joined, 32)
    assert asked[-1].rdd.getNumPartitions() > 4
    for r in places.collect():
        at = next((w for w in want if w[1] > r.x), None)
        assert (r.off, r.place) == ((None, "after") if at is None else (at[0], "inside" if r.x >= at[0] else "before"))
