"""JSON documents as trees, values at paths inside them, their equality and their merge."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settle


class _ABSENT:
    """No value at all, which is not the JSON value null; a class is the same in every worker."""


# How conflicts are named.
DATATYPES, ADD_ADD, CHANGED, ADD_DEL = "Conflicting JSON datatypes", "default: add/add and no common ancestor", "default", "option: add/del"


def project(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id_col, path, value``: a leaf for each scalar and array, as JSON text; objects are
    directories and empty ones vanish. A round a level, as many as the deepest document has;
    what is left to open is written down after each."""
    spark = df.sparkSession
    level = df.select(F.col(id_col), F.array().cast("array<string>").alias("path"), F.col(json_col).alias("v"))
    out = None
    while True:
        level = settle(level.withColumn("object", F.schema_of_variant(F.parse_json("v")).startswith("OBJECT")))
        leaves = level.where(~F.col("object")).select(id_col, "path", F.to_json(F.parse_json("v")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.where("object")
        if inner.isEmpty():
            return out
        level = spark.sql(f"select `{id_col}`, concat(path, array(key)) as path, to_json(value) as v from {{rows}}, lateral variant_explode(parse_json(v))", rows=inner)


def assemble(leaves: DataFrame, id_col: str) -> DataFrame:
    """``id_col, value``: the documents whose leaves (``id_col, path, value``) these are, keys
    in order. A grouping a level, from the deepest up; the members of one object meet in one
    row, as they do in its text."""
    deepest = leaves.agg(F.max(F.size("path"))).first()[0] or 0
    rest, below = leaves.select(id_col, "path", "value"), None
    for depth in range(deepest, 0, -1):
        here = rest.where(F.size("path") == depth)
        here = here if below is None else here.unionByName(below)
        step = F.get(F.col("path"), F.lit(depth - 1))
        members = F.sort_array(F.collect_list(F.struct(step.alias("step"), F.concat(_quoted(step), F.lit(":"), "value").alias("member"))))
        below = here.groupBy(id_col, F.slice("path", 1, depth - 1).alias("path")).agg(members.alias("m")).select(id_col, "path", F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: x["member"]), ","), F.lit("}")).alias("value"))
    roots = rest.where(F.size("path") == 0)
    return (roots if below is None else roots.unionByName(below)).select(id_col, "value")


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def value_at(document: Column, path: list[str]) -> Column:
    """The JSON text at a path of a document: an object below it too; null where there is none."""
    at = "$" + "".join(f"['{step}']" for step in path)
    return F.to_json(F.try_variant_get(F.parse_json(document), at, "variant"))


def put(leaves: DataFrame, id_col: str, path: list[str], documents: DataFrame, json_col: str) -> DataFrame:
    """Projected documents (``id_col, path, value``) with that of ``documents`` (``id_col,
    json_col``) in place of what stands at ``path``, and of a leaf on the way to it."""
    n, here = len(path), F.array(*map(F.lit, path)).cast("array<string>")
    new = project(documents, id_col, json_col).withColumn("path", F.concat(here, "path"))
    ids = documents.select(id_col).distinct().withColumn("_new", F.lit(True))
    way = (F.slice("path", 1, n) == here) | ((F.size("path") < n) & (F.slice(here, 1, F.size("path")) == F.col("path")))
    kept = leaves.join(ids, id_col, "left").where(F.col("_new").isNull() | ~way).drop("_new")
    return kept.unionByName(new)


def canonical(document: Column) -> Column:
    """One text for all JSON texts of the same value: keys in order, no white space."""
    return F.to_json(F.parse_json(document))


def merge_json(old: Column, ours: Column, theirs: Column) -> Column:
    """``struct(ok, value, conflict)`` of JSON texts by type: numbers, strings and booleans by
    default, arrays if equal or changed on one side, objects key by key, other pairs of types
    conflict. A null column is absence; the JSON value null is a value, but no ancestor."""

    @F.pandas_udf("ok boolean, value string, conflict string")
    def of(o: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        load = lambda t: _ABSENT if t is None or pd.isna(t) else json.loads(t)
        rows = []
        for x, y, z in zip(o, a, b, strict=True):
            try:
                made = _option(load(x), load(y), load(z))
                rows.append((True, None if made is _ABSENT else json.dumps(made, sort_keys=True, ensure_ascii=False), None))
            except ValueError as why:
                rows.append((False, None, str(why)))
        return pd.DataFrame(rows, columns=["ok", "value", "conflict"])

    return of(old, ours, theirs)


def _type(v) -> str:
    return "number" if isinstance(v, int | float) and not isinstance(v, bool) else type(v).__name__


def _same(x, y) -> bool:
    """Equality of JSON values: true is not 1, and keys have no order."""
    if x is _ABSENT or y is _ABSENT:
        return x is y
    if _type(x) != _type(y):
        return False
    if isinstance(x, dict):
        return x.keys() == y.keys() and all(_same(v, y[k]) for k, v in x.items())
    if isinstance(x, list):
        return len(x) == len(y) and all(map(_same, x, y))
    return x == y


def _option(o, a, b):
    """Absence is a value of its own here: an unchanged side gives way."""
    if _same(o, a):
        return b
    if _same(o, b):
        return a
    if a is _ABSENT or b is _ABSENT:
        if a is b or o is _ABSENT:
            return b if a is _ABSENT else a
        raise ValueError(ADD_DEL)
    return _merge(o, a, b)


def _merge(o, a, b):
    o = _ABSENT if o is None else o
    if o is _ABSENT and a is None and b is None:
        return None
    if a is None or _type(a) != _type(b) or (o is not _ABSENT and _type(o) != _type(a)):
        raise ValueError(DATATYPES)
    if isinstance(a, dict):
        before = {} if o is _ABSENT else o
        made = {k: _option(before.get(k, _ABSENT), a.get(k, _ABSENT), b.get(k, _ABSENT)) for k in {**a, **b}}
        return {k: v for k, v in made.items() if v is not _ABSENT}
    if isinstance(a, list) and _same(a, b):
        return a
    if o is _ABSENT:
        raise ValueError(ADD_ADD)
    if _same(o, a):
        return b
    if _same(o, b):
        return a
    raise ValueError(CHANGED)
