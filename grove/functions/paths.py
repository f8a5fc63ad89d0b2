"""Paths: arrays of steps, written ``/a/b``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """Steps of a written path; empty segments are dropped."""
    return F.filter(F.split(text, "/"), lambda s: s != "")


def show(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(path, "/"))


def literal(steps: list[str]) -> Column:
    return F.array(*map(F.lit, steps)).cast("array<string>")


def cons(step: Column, path: Column) -> Column:
    return F.concat(F.array(step), path)


def rcons(path: Column, step: Column) -> Column:
    return F.concat(path, F.array(step))


def first(path: Column) -> Column:
    """The first step, null for the root."""
    return F.get(path, F.lit(0))


def rest(path: Column) -> Column:
    return F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))


def last(path: Column) -> Column:
    return F.get(path, F.size(path) - 1)


def parent(path: Column) -> Column:
    """All but the last step; the root is its own parent."""
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def prefix(path: Column, n: Column | int) -> Column:
    return F.slice(path, 1, n if isinstance(n, Column) else F.lit(n))


def prefixes(path: Column) -> Column:
    """All proper prefixes, the root first."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: F.slice(path, 1, n))).otherwise(F.array().cast("array<array<string>>"))


def starts_with(path: Column, steps: list[str]) -> Column:
    return F.slice(path, 1, len(steps)) == literal(steps) if steps else F.lit(True)


BRANCH = "^[A-Za-z0-9_./-]*$"  # Fixed value: names that a branch may have


def valid_branch(name: Column) -> Column:
    """Whether a branch may have this name."""
    return name.rlike(BRANCH)


# How a commit's date is written in logs.
LOG_DATE = "E MMM dd HH:mm:ss yyyy"


def log_date(seconds: Column) -> Column:
    """A commit's date in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), LOG_DATE)


def author_name(author: Column) -> Column:
    """``Name`` of ``Name <mail>``; all of it where there is no mail."""
    return F.trim(F.regexp_replace(author, r"\s*<[^>]*>\s*$", ""))


def author_mail(author: Column) -> Column:
    found = F.regexp_extract(author, r"<([^>]*)>\s*$", 1)
    return F.when(found != "", found)


def info(date: Column | None = None, author: Column | None = None, message: Column | None = None) -> Column:
    """What a commit says of itself: ``struct(date, author, message)``, 0 and empty where not given."""
    return F.struct((F.lit(0) if date is None else date).cast("long").alias("date"), (F.lit("") if author is None else author).alias("author"), (F.lit("") if message is None else message).alias("message"))


def no_info(value: Column) -> Column:
    """Whether it says nothing: all as by default."""
    return (value["date"] == 0) & (value["author"] == "") & (value["message"] == "")


def reference(text: Column) -> Column:
    """``struct(kind, name)`` of a written reference: branch, remote, tag, other, or null for
    what is none."""
    name = F.regexp_extract(text, "^refs/(?:heads|remotes|tags)/(.+)$", 1)
    kind = F.when(text.startswith("refs/heads/"), "branch").when(text.startswith("refs/remotes/"), "remote").when(text.startswith("refs/tags/"), "tag").when(text == "HEAD", "head").when(text.startswith("refs/"), "other")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(name != "", name).otherwise(text).alias("name")))


def valid_text(raw: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(raw.cast("string"))
