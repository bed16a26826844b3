"""Building the findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default vector of each level.
LEVEL_VECTORS = {
    "Critical": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "High": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "Medium": "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:L/A:N",
    "Low": "CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:N/A:N",
}
LEVELS = ["Critical", "High", "Medium", "Low", "Info"]


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text_map(items: dict) -> Column:
    """MAP<STRING,STRING> of scalar columns; pass arrays and structs as JSON text."""
    if not items:
        return F.create_map().cast("map<string,string>")
    cells = []
    for key, value in items.items():
        cells += [F.lit(key), _column(value).cast("string")]
    return F.create_map(*cells)


def severity(level, score) -> Column:
    level = _column(level)
    vector = F.lit(None).cast("string")
    for name, text in LEVEL_VECTORS.items():
        vector = F.when(level == name, text).otherwise(vector)
    return F.struct(
        level.alias("level"),
        _column(score).cast("double").alias("cvss_score"),
        vector.alias("cvss_vector"),
    )


DEFAULT_ADVICE = "Review this artifact before loading it."


def hit(
    scanner: str,
    kind,
    level,
    score,
    description,
    *,
    location: dict | None = None,
    evidence: dict | None = None,
    advice=DEFAULT_ADVICE,
    references=None,
    cwe=None,
    cve=None,
) -> Column:
    """One possible finding of a row, as a struct.

    A detector that looks at one row at a time is a column: an array of hits.
    Several of them can then share one pass over the content.
    """
    if not isinstance(references, Column):
        references = F.array(*[F.lit(r) for r in references or []])
    return F.struct(
        F.lit(scanner).alias("scanner"),
        _column(kind).alias("kind"),
        _column(level).alias("level"),
        _column(score).cast("double").alias("score"),
        _column(description).alias("description"),
        text_map(location or {}).alias("location"),
        text_map(evidence or {}).alias("evidence"),
        _column(advice).alias("advice"),
        references.cast("array<string>").alias("references"),
        _column(cwe).cast("string").alias("cwe"),
        _column(cve).cast("string").alias("cve"),
    )


def hits_if(*tests: tuple[Column, Column]) -> Column:
    """Array of the hits whose test is true."""
    return F.array_compact(F.array(*[F.when(test, found) for test, found in tests]))


def _projected(df: DataFrame) -> DataFrame:
    """Rows of (path, source, h) in the fixed 13 columns.

    The id is a digest of what was found and where, so it does not depend on
    the order in which tasks run.
    """
    h = lambda name: F.col(f"h.{name}")
    location = F.map_concat(F.create_map(F.lit("file"), F.col("source")), h("location"))
    identity = F.concat_ws(
        "|", "source", h("scanner"), h("kind"), F.to_json(location), h("description")
    )
    return df.select(
        "path",
        "source",
        h("scanner").alias("scanner"),
        h("kind").alias("vulnerability_type"),
        severity(h("level"), h("score")).alias("severity"),
        h("description").alias("description"),
        location.alias("location"),
        h("evidence").alias("evidence"),
        h("advice").alias("recommendation"),
        h("references").alias("references"),
        h("cwe").alias("cwe_id"),
        h("cve").alias("cve_id"),
        F.concat(F.lit("VULN-"), F.substring(F.sha2(identity, 256), 1, 16)).alias("finding_id"),
    )


def findings_of(df: DataFrame, hits: Column) -> DataFrame:
    """Findings of the hits of every row; ``df`` has ``path`` and ``source``."""
    return _projected(df.select("path", "source", F.explode(hits).alias("h")))


def as_findings(df: DataFrame, scanner: str, kind, level, score, description, **more) -> DataFrame:
    """One finding per row."""
    found = hit(scanner, kind, level, score, description, **more)
    return _projected(df.select("path", "source", found.alias("h")))


def flat(findings: DataFrame, *evidence: str, **location: str) -> DataFrame:
    """Scalar view of findings: severity unpacked, chosen map keys as columns."""
    return findings.select(
        "source",
        "scanner",
        "vulnerability_type",
        F.col("severity.level").alias("level"),
        F.col("severity.cvss_score").alias("cvss_score"),
        "cwe_id",
        "cve_id",
        *[F.col("evidence")[key].alias(key) for key in evidence],
        *[F.col("location")[key].alias(name) for name, key in location.items()],
    )
