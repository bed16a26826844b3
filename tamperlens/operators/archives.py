"""Zip and tar rules over a members table.

``members`` has ``path``, ``ordinal``, ``entry``, ``origin`` (central, local or
tar), ``unix_mode``, ``is_link`` and ``link_target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.findings import as_findings
from tamperlens.functions.groups import capped_lists
from tamperlens.functions.paths import is_unsafe_entry

SHOWN = 10
# File type bits of a Unix mode, and the value for a link.
TYPE_BITS, LINK_TYPE = 0o170000, 0o120000

_REFS = ["https://research.jfrog.com/model-threats/zipslip/"]


def has_traversal(entry: Column) -> Column:
    return F.contains(entry, F.lit(".."))


def is_absolute(entry: Column) -> Column:
    return F.startswith(entry, F.lit("/")) | (F.substring(entry, 2, 1) == ":")


def safe_members(members: DataFrame) -> DataFrame:
    """Members that would stay inside the directory they are unpacked to.

    Links in tar files are left out as well.
    """
    tar_link = (F.col("origin") == "tar") & F.col("is_link")
    return members.where(~is_unsafe_entry(F.col("entry")) & ~F.coalesce(tar_link, F.lit(False)))


def _grouped(rows: DataFrame, item: Column, scanner_kind: str, score: float, level: str, text: str, cwe: str) -> DataFrame:
    per_file = capped_lists(rows, ["path"], item, SHOWN).withColumn("source", F.col("path"))
    return as_findings(
        per_file,
        "zip_slip",
        scanner_kind,
        level,
        score,
        F.concat(F.lit("Archive holds "), F.col("total").cast("string"), F.lit(f" {text}")),
        evidence={"entries": F.to_json("items"), "total": F.col("total")},
        advice="Do not unpack this archive.",
        references=_REFS,
        cwe=cwe,
    )


def zip_traversal(members: DataFrame) -> DataFrame:
    rows = members.where((F.col("origin") == "central") & has_traversal(F.col("entry")))
    return _grouped(rows, F.col("entry"), "Zip Slip - Path Traversal", 7.5, "High", "entries that climb out", "CWE-22")


def zip_symlink(members: DataFrame) -> DataFrame:
    link = F.col("unix_mode").bitwiseAND(TYPE_BITS) == LINK_TYPE
    rows = members.where((F.col("origin") == "central") & link)
    return _grouped(rows, F.col("entry"), "Zip Slip - Symlink Attack", 7.0, "High", "link entries", "CWE-59")


def zip_absolute(members: DataFrame) -> DataFrame:
    rows = members.where((F.col("origin") == "central") & is_absolute(F.col("entry")))
    return _grouped(rows, F.col("entry"), "Zip Slip - Absolute Path", 6.0, "Medium", "absolute entries", "CWE-22")


def tar_traversal(members: DataFrame) -> DataFrame:
    rows = members.where((F.col("origin") == "tar") & has_traversal(F.col("entry")))
    return _grouped(rows, F.col("entry"), "Tar Slip - Path Traversal", 7.5, "High", "entries that climb out", "CWE-22")


def tar_symlink(members: DataFrame) -> DataFrame:
    target = F.col("link_target")
    outside = F.startswith(target, F.lit("/")) | F.contains(target, F.lit(".."))
    rows = members.where((F.col("origin") == "tar") & F.col("is_link") & outside)
    item = F.concat(F.col("entry"), F.lit(" -> "), target)
    return _grouped(rows, item, "Tar Slip - Dangerous Symlink", 7.5, "High", "links that point outside", "CWE-59")


def header_mismatch(members: DataFrame) -> DataFrame:
    """Names listed in only one of the local headers and the central directory.

    One aggregation on (path, entry) replaces a full outer join of the two lists.
    """
    sides = (
        members.where(F.col("origin").isin("central", "local"))
        .groupBy("path", "entry")
        .agg(
            F.bool_or(F.col("origin") == "central").alias("central"),
            F.bool_or(F.col("origin") == "local").alias("local"),
        )
        .where(F.col("central") != F.col("local"))
    )
    item = F.concat(F.when(F.col("local"), "local: ").otherwise("central: "), F.col("entry"))
    per_file = capped_lists(sides, ["path"], item, 5).withColumn("source", F.col("path"))
    return as_findings(
        per_file,
        "zip_slip",
        "Zip Slip - Header Mismatch",
        "High",
        7.5,
        F.concat(F.col("total").cast("string"), F.lit(" names differ between local headers and directory")),
        evidence={"entries": F.to_json("items"), "total": F.col("total")},
        advice="Do not trust listings of this archive.",
        cwe="CWE-22",
        cve="CVE-2025-1944",
    )


def archive_findings(members: DataFrame) -> DataFrame:
    found = zip_traversal(members)
    for rule in (zip_symlink, zip_absolute, header_mismatch, tar_traversal, tar_symlink):
        found = found.unionByName(rule(members))
    return found
