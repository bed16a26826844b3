"""Combining, counting, filtering and gating findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.findings import LEVELS


def union(findings: list[DataFrame]) -> DataFrame:
    """All findings, duplicates kept; ids do not depend on the order."""
    return reduce(DataFrame.unionByName, findings)


def level_rank(level: Column) -> Column:
    """0 for the most severe level; unknown levels come last."""
    rank = F.lit(len(LEVELS))
    for i, name in enumerate(LEVELS):
        rank = F.when(F.lower(level) == name.lower(), i).otherwise(rank)
    return rank


def _counts() -> list[Column]:
    level = F.lower("severity.level")
    return [F.count(F.lit(1)).alias("total_vulnerabilities")] + [
        F.count_if(level == name).alias(name) for name in ("critical", "high", "medium", "low")
    ]


def summary(findings: DataFrame, target: str = "path") -> DataFrame:
    """Counts per level, per target and overall (target NULL)."""
    return findings.rollup(F.col(target).alias("target")).agg(*_counts())


def threshold(findings: DataFrame, level: str = "low") -> DataFrame:
    """Findings at least as severe as ``level``."""
    bound = [name.lower() for name in LEVELS].index(level.lower())
    return findings.where(level_rank(F.col("severity.level")) <= bound)


def gate(findings: DataFrame, fail_on_critical: bool = True, fail_on_high: bool = False) -> DataFrame:
    """One row: the counts and whether the scan fails."""
    level = F.lower("severity.level")
    counted = findings.agg(
        F.count_if(level == "critical").alias("critical"), F.count_if(level == "high").alias("high")
    )
    failed = (F.lit(fail_on_critical) & (F.col("critical") > 0)) | (
        F.lit(fail_on_high) & ((F.col("critical") > 0) | (F.col("high") > 0))
    )
    return counted.withColumn("failed", failed)


def listing(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Level, type, file and the start of the description, most severe first."""
    rows = findings.select(
        F.upper("severity.level").alias("level"),
        "vulnerability_type",
        F.coalesce(F.col("location")["file"], F.lit("N/A")).alias("file"),
        F.substring("description", 1, 80).alias("description"),
        "finding_id",
    )
    order = [level_rank(F.col("level")), F.col("vulnerability_type"), F.col("file"), F.col("finding_id")]
    rows = rows.orderBy(*order)
    return rows if top is None else rows.limit(top)
