"""Three-way merges as columns.

A merge takes ancestor, ours and theirs and gives ``struct(ok, value, conflict)``. An
ancestor may be absent as such, which is not the same as an ancestor whose value is null:
the builders take ``known``, whether there is an ancestor at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Merge = Callable[[Column, Column, Column, Column], Column]


def done(value: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), value.alias("value"), F.lit(None).cast("string").alias("conflict"))


def fails(like: Column, why: str | Column) -> Column:
    why = F.lit(why) if isinstance(why, str) else why
    return F.struct(F.lit(False).alias("ok"), F.when(F.lit(False), like).alias("value"), why.alias("conflict"))


def default(known: Column, old: Column, a: Column, b: Column) -> Column:
    """One side must be unchanged; equal changes conflict all the same."""
    return (
        F.when(~known, fails(a, "default"))
        .when(old.eqNullSafe(a), done(b))
        .when(old.eqNullSafe(b), done(a))
        .otherwise(fails(a, "default"))
    )


def idempotent(known: Column, old: Column, a: Column, b: Column) -> Column:
    """Equal values agree, whatever the ancestor."""
    return F.when(a.eqNullSafe(b), done(a)).otherwise(default(known, old, a, b))


def counter(known: Column, old: Column, a: Column, b: Column) -> Column:
    """Both sides' changes add up; no ancestor counts as 0. Sums that leave 64 bits wrap round."""
    exact = a.cast("decimal(20,0)") + b - F.when(known, F.coalesce(old, F.lit(0))).otherwise(F.lit(0))
    span = F.lit("18446744073709551616").cast("decimal(38,0)")
    wrapped = F.pmod(exact.cast("decimal(38,0)") + F.lit("9223372036854775808").cast("decimal(38,0)"), span) - F.lit("9223372036854775808").cast("decimal(38,0)")
    return done(wrapped.cast("long"))


def latest(known: Column, old: Column, a: Column, b: Column) -> Column:
    """Of structs, the greatest; the ancestor plays no part."""
    return done(F.greatest(a, b))


def option(inner: Merge) -> Merge:
    """Null is absence: an unchanged side gives way to a deletion, a changed one conflicts."""

    def merge(known: Column, old: Column, a: Column, b: Column) -> Column:
        nothing = F.when(F.lit(False), a)
        one_sided = lambda mine: (
            F.when(~known | old.isNull(), done(mine)).when(old.eqNullSafe(mine), done(nothing)).otherwise(fails(a, "option: add/del"))
        )
        return (
            F.when(known & old.eqNullSafe(a), done(b))
            .when(known & old.eqNullSafe(b), done(a))
            .when(a.isNull() & b.isNull(), done(nothing))
            .when(b.isNull(), one_sided(a))
            .when(a.isNull(), one_sided(b))
            .otherwise(inner(known & old.isNotNull(), old, a, b))
        )

    return merge


def struct_of(fields: dict[str, Merge]) -> Merge:
    """Pairs, triples and records: default on the whole, else field by field; the first
    field that fails names the conflict."""

    def merge(known: Column, old: Column, a: Column, b: Column) -> Column:
        parts = {n: m(known, old[n], a[n], b[n]) for n, m in fields.items()}
        every = F.forall(F.array(*[p["ok"] for p in parts.values()]), lambda x: x)
        whole = F.struct(*[p["value"].alias(n) for n, p in parts.items()])
        by_field = F.when(every, done(whole)).otherwise(fails(whole, F.coalesce(*[p["conflict"] for p in parts.values()])))
        return F.when(known & old.eqNullSafe(a), done(b)).when(known & old.eqNullSafe(b), done(a)).otherwise(by_field)

    return merge


def first_of(*merges: Merge) -> Merge:
    """The first merge that succeeds; the last one's conflict if none does."""
    if not merges:
        raise ValueError("first_of needs a merge")

    def merge(known: Column, old: Column, a: Column, b: Column) -> Column:
        tried = [m(known, old, a, b) for m in merges]
        out = tried[-1]
        for t in reversed(tried[:-1]):
            out = F.when(t["ok"], t).otherwise(out)
        return out

    return merge


def like(inner: Merge, into: Callable[[Column], Column], back: Callable[[Column], Column]) -> Merge:
    """Merge through a bijection: default first, then ``inner`` on the images."""

    def merge(known: Column, old: Column, a: Column, b: Column) -> Column:
        m = inner(known, into(old), into(a), into(b))
        plain = default(known, old, a, b)
        return F.when(plain["ok"], plain).when(m["ok"], done(back(m["value"]))).otherwise(fails(a, m["conflict"]))

    return merge


def with_conflict(inner: Merge, rewrite: Callable[[Column], Column]) -> Merge:
    def merge(known: Column, old: Column, a: Column, b: Column) -> Column:
        m = inner(known, old, a, b)
        return F.when(m["ok"], m).otherwise(fails(a, rewrite(m["conflict"])))

    return merge


def sets(old: Column, a: Column, b: Column) -> Column:
    """Arrays as sets: what either side added, less what either removed; never conflicts."""
    old = F.coalesce(old, F.array())
    gone = F.array_union(F.array_except(old, a), F.array_except(old, b))
    return F.array_sort(F.array_except(F.array_union(F.array_union(old, a), b), gone))


#: Plain values (strings, numbers) by default; string contents.
string_contents = idempotent
