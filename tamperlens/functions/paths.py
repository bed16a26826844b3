"""Columns over file and entry names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Last suffix in lower case, with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def full_suffix(path: Column) -> Column:
    """``.tar.gz`` and ``.tar.bz2`` as one suffix, else the plain extension."""
    lowered = F.lower(path)
    return (
        F.when(F.endswith(lowered, F.lit(".tar.gz")), ".tar.gz")
        .when(F.endswith(lowered, F.lit(".tar.bz2")), ".tar.bz2")
        .otherwise(extension(path))
    )


def is_unsafe_entry(entry: Column) -> Column:
    """True when the name, once ``.`` and ``a/..`` are folded, leaves its root.

    Walking the components keeps a depth; the name escapes when it is absolute
    or when the depth ever falls below zero.
    """
    steps = F.transform(
        F.split(entry, "/"),
        lambda part: F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1),
    )
    lowest = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, step: F.struct(
            (acc["depth"] + step).alias("depth"),
            F.least(acc["low"], acc["depth"] + step).alias("low"),
        ),
    )["low"]
    return F.startswith(entry, F.lit("/")) | (lowest < 0)
