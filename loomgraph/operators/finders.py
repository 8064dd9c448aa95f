"""Finders: rows by conjunctions of equalities, lists and ranges, in a defined order; checks of single values."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows that fulfil all conditions, which reach the scan: a value (equality), a list (IN) or a pair ``(from, to)`` (both included). None is no condition."""

    def test(name: str, value: Any) -> Column:
        c = F.col(name)
        if isinstance(value, tuple):
            return c.between(*value)
        return c.isin(*value) if isinstance(value, list) else c == value

    tests = [test(k, v) for k, v in wanted.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def name_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows with ``part`` in a column, whatever the case."""
    return df.filter(F.contains(F.lower(column), F.lit(part.lower())))


def listed(df: DataFrame, column: str, item: str) -> DataFrame:
    """Rows with ``item`` in a comma-separated list, as a whole and in the same case."""
    return df.filter(F.array_contains(F.split(column, ","), item))


def has_role(df: DataFrame, role: str, summary: str = "summary") -> DataFrame:
    """Rows whose summary names the role after 'Roles:'."""
    return df.filter(F.contains(summary, F.lit("Roles:")) & F.contains(summary, F.lit(role)))


def changed_files(df: DataFrame, change: str, path: str, suffix: str = ".java") -> DataFrame:
    """Rows of files that are still there after the change and end in ``suffix``."""
    return df.filter((F.col(change) != "DELETE") & F.col(path).endswith(suffix))


def valid_git_url(url: Column) -> Column:
    """Is it an https, http, ssh or scp-like address of a repository, of at most 2048 characters and without control or shell characters?"""
    clean = F.length(url).between(1, 2048) & ~url.rlike(r"[\s;|&$`<>\\'\"(){}]") & ~F.contains(url, F.lit(".."))
    return F.coalesce(clean & url.rlike(r"^(?:(?:https?|ssh|git)://[\w.@:\-]+/|[\w.\-]+@[\w.\-]+:)[\w.\-/~?=%]+$"), F.lit(False))


def valid_branch(name: Column) -> Column:
    """Is it a branch name: letters, digits and ``._/-``, at most 255, no ``..``, ``//``, ``@{``, no slash or dot at the ends, not beginning with a dash?"""
    ok = F.length(name).between(1, 255) & name.rlike(r"^[\w./\-]+$") & ~name.rlike(r"\.\.|//|^[-./]|[./]$|\.lock$")
    return F.coalesce(ok, F.lit(False))


def parse_git_url(url: Column, default_branch: str = "main") -> Column:
    """struct<clone_url, branch, repo_name> of an address that may name a branch (``/tree/<branch>``, ``/-/tree/<branch>`` or ``/src/<branch>``); null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.btrim(url, F.lit(" \t")), r"[?#].*$", ""), r"/+$", "")
    branch = F.regexp_extract(plain, r"/(?:-/)?(?:tree|src)/(.+)$", 1)
    base = F.regexp_replace(F.regexp_replace(plain, r"/(?:-/)?(?:tree|src)/.*$", ""), r"\.git$", "")
    name = F.regexp_extract(base, r"([^/:]+)$", 1)
    made = F.struct(base.alias("clone_url"), F.when(branch != "", branch).otherwise(default_branch).alias("branch"), name.alias("repo_name"))
    return F.when((name != "") & base.rlike(r"[/:]"), made)


def contains_all(have: Column, required: list[str]) -> Column:
    """Are all required items in the array? An empty list is always fulfilled."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, required)) if required else F.array().cast("array<string>"), have)) == 0, F.lit(not required))
