"""Which rows a caller may see, and other predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(acl: Column, tags: Column, acls: Column, wanted: Column) -> Column:
    """acls null: all; empty: nothing.  wanted null or empty: all; else a common tag is needed."""
    by_acl = acls.isNull() | F.coalesce(F.array_contains(acls, acl), F.lit(False))
    by_tag = wanted.isNull() | (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(tags, wanted), F.lit(False))
    return by_acl & by_tag


def visible_to(acls: list[str] | None, tags: list[str] | None, acl: str = "acl", tag: str = "tags") -> Column:
    """The same with lists of the driver, as a predicate that reaches the scan."""
    out = F.lit(True) if acls is None else F.col(acl).isin(*acls) if acls else F.lit(False)
    return out & F.arrays_overlap(F.coalesce(tag, F.array().cast("array<string>")), F.array(*map(F.lit, tags))) if tags else out


def in_section(section: Column, path: Column) -> Column:
    """Under a path, or without a section."""
    s = F.coalesce(section, F.lit(""))
    return (s == "") | (s == path) | F.startswith(s, F.concat(path, F.lit(" > ")))


def relevant(path: Column, title: Column, patterns: Column) -> Column:
    """Whether path and title hold any of the patterns, in lower case."""
    where = F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(title, F.lit(""))))
    return F.coalesce(F.exists(patterns, lambda p: F.contains(where, F.lower(p))), F.lit(False))


def tag_set(tags: Column) -> Column:
    """Sorted, without repetitions; null as empty."""
    return F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))))
