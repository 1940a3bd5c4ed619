"""Filters as Column builders: who may see a row, and when it is valid and known. Ends of intervals are open when null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def authz(project: int, scopes: list[str], alias: str = "") -> Column:
    """The version row itself names the project and one of the device scopes."""
    c = lambda n: F.col(f"{alias}{n}")
    return F.array_contains(c("project_ids"), project) & c("device_scope").isin(scopes)


def scopes_of(device: int, device_class: str) -> list[str]:
    return ["all", f"class:{device_class}", f"device:{device}"]


def since_until(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end."""
    return (start <= at) & (end.isNull() | (at < end))


def temporal_live(valid_at: str, known_at: str, alias: str = "") -> Column:
    """Valid at one instant as known at another; both axes half-open."""
    c = lambda n: F.col(f"{alias}{n}")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return since_until(c("valid_from"), c("valid_to"), at(valid_at)) & since_until(c("recorded_at"), c("superseded_at"), at(known_at))


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Half-open intervals that share an instant; touching ones don't."""
    return (b[1].isNull() | (a[0] < b[1])) & (a[1].isNull() | (b[0] < a[1]))


def hit_filter(project: int, scopes: list[str], valid_at: str, known_at: str, statuses: list[str]) -> Column:
    return authz(project, scopes) & temporal_live(valid_at, known_at) & F.col("status").isin(statuses)


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first failing check, or null."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for bad, name in checks))


def glob(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the patterns, where * stops at a slash and ** doesn't."""
    turn = lambda p: "^" + p.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*") + "$"
    return reduce(lambda a, b: a | b, (path.rlike(turn(p)) for p in patterns))
