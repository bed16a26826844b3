"""SARIF and JSON report rows and documents.

A target may have any number of findings, so a document holds one part of them:
parts are cut by a hash of the finding id to about ``part_size`` findings. A
target with fewer findings than that has exactly one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens import __version__
from tamperlens.functions.text import first_match
from tamperlens.operators.algebra import summary
from tamperlens.functions.groups import small_table
from tamperlens.rules import markers as M

TOOL = "tamperlens"
PART_SIZE = 5000
# How much evidence a result shows.
SHOWN_ENTRIES, SHOWN_CHARS = 5, 200


def rule_number(kind: Column) -> Column:
    """Number of the first rule keyword in the finding type, 0 when none occurs."""
    lowered = F.lower(kind)
    tests = [(F.contains(lowered, F.lit(word)), number) for word, number in M.SARIF_KEYWORDS]
    return F.coalesce(first_match(tests), F.lit(0))


def rule_id(kind: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(rule_number(kind).cast("string"), 3, "0"))


def sarif_level(level: Column) -> Column:
    tests = [(F.lower(level) == word, name) for word, name in M.SARIF_LEVELS.items()]
    return F.coalesce(first_match(tests), F.lit("none"))


def artifact_uri(path: Column) -> Column:
    forward = F.translate(path, "\\", "/")
    return (
        F.when(F.startswith(forward, F.lit("/")), F.concat(F.lit("file://"), forward))
        .when(F.substring(forward, 2, 1) == ":", F.concat(F.lit("file:///"), forward))
        .otherwise(forward)
    )


def sarif_results(findings: DataFrame, prefix: str = "RULE") -> DataFrame:
    """One result row per finding."""
    entries = F.slice(F.array_sort(F.map_entries("evidence")), 1, SHOWN_ENTRIES)
    shown = F.transform(
        entries,
        lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(F.substring(e["value"], 1, SHOWN_CHARS), F.lit("None"))),
    )
    return findings.select(
        F.col("path").alias("target"),
        rule_id(F.col("vulnerability_type"), prefix).alias("rule_id"),
        sarif_level(F.col("severity.level")).alias("level"),
        F.col("description").alias("message"),
        artifact_uri(F.coalesce(F.col("location")["file"], F.lit("unknown"))).alias("uri"),
        "vulnerability_type",
        F.col("severity.cvss_score").alias("cvss_score"),
        F.col("severity.cvss_vector").alias("cvss_vector"),
        "cwe_id",
        "cve_id",
        F.col("recommendation").alias("fix"),
        shown.alias("related"),
        "finding_id",
    )


def sarif_rules(spark, prefix: str = "RULE") -> DataFrame:
    rows = [(f"{prefix}{number:03d}", name, level, score) for number, name, level, score in M.SARIF_RULES]
    return small_table(spark, rows, "rule_id string, name string, default_level string, security_severity string")


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """Add ``part`` and ``parts`` of each target."""
    sizes = rows.groupBy("target").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.lit(1)).cast("int").alias("parts")
    )
    return rows.join(sizes, "target").withColumn(
        "part", F.pmod(F.xxhash64("finding_id"), F.col("parts").cast("bigint")).cast("int")
    )


def sarif_documents(findings: DataFrame, prefix: str = "RULE", part_size: int = PART_SIZE) -> DataFrame:
    """(target, part, parts, document): SARIF 2.1.0 text of each part."""
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(F.struct(F.struct("uri").alias("artifactLocation")).alias("physicalLocation"))
        ).alias("locations"),
        F.struct(
            F.col("finding_id").alias("vulnerability_id"), "vulnerability_type", "cvss_score", "cvss_vector", "cwe_id", "cve_id"
        ).alias("properties"),
        F.array(F.struct(F.struct(F.col("fix").alias("text")).alias("description"))).alias("fixes"),
        F.transform("related", lambda t: F.struct(F.struct(t.alias("text")).alias("message"))).alias("relatedLocations"),
    )
    rules = F.array(
        *[
            F.struct(
                F.lit(f"{prefix}{number:03d}").alias("id"),
                F.lit(name).alias("name"),
                F.struct(F.lit(level).alias("level")).alias("defaultConfiguration"),
                F.struct(F.lit(score).alias("security-severity")).alias("properties"),
            )
            for number, name, level, score in M.SARIF_RULES
        ]
    )
    cut = _parts(sarif_results(findings, prefix), part_size)
    grouped = cut.groupBy("target", "part", "parts").agg(
        F.array_sort(F.collect_list(F.struct("finding_id", result.alias("result")))).alias("rows")
    )
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(__version__).alias("version"), rules.alias("rules"))
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"),
        F.transform("rows", lambda r: r["result"]).alias("results"),
        F.array(F.struct(F.struct(F.col("target").alias("uri")).alias("location"))).alias("artifacts"),
    )
    document = F.struct(
        F.lit("https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json").alias("$schema"),
        F.lit("2.1.0").alias("version"),
        F.array(run).alias("runs"),
    )
    return grouped.select("target", "part", "parts", F.to_json(document).alias("document"))


def report_rows(
    findings: DataFrame,
    include_evidence: bool = True,
    include_recommendations: bool = True,
    include_references: bool = True,
) -> DataFrame:
    """Findings as they stand in a report; evidence may be hidden, advice and references dropped."""
    columns = [
        F.col("finding_id").alias("id"),
        "scanner",
        "vulnerability_type",
        "severity",
        "description",
        "location",
        (F.col("evidence") if include_evidence else F.create_map(F.lit("redacted"), F.lit("true"))).alias("evidence"),
    ]
    if include_recommendations:
        columns.append("recommendation")
    if include_references:
        columns.append("references")
    return findings.select(F.col("path").alias("target"), *columns, "cwe_id", "cve_id")


def json_reports(findings: DataFrame, part_size: int = PART_SIZE, **options) -> DataFrame:
    """(target, part, parts, summary, vulnerabilities): one report row per part.

    Every part repeats the summary of its whole target.
    """
    rows = report_rows(findings, **options).withColumn("finding_id", F.col("id"))
    cut = _parts(rows, part_size).drop("finding_id")
    fields = [c for c in cut.columns if c not in ("target", "part", "parts")]
    grouped = cut.groupBy("target", "part", "parts").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("id").alias("_id"), F.to_json(F.struct(*fields)).alias("_row")))),
            lambda r: r["_row"],
        ).alias("_rows")
    )
    counts = summary(findings).where(F.col("target").isNotNull())
    names = ["total_vulnerabilities", "critical", "high", "medium", "low"]
    return grouped.join(counts, "target").select(
        "target",
        "part",
        "parts",
        F.to_json(F.struct(*names)).alias("summary"),
        F.concat(F.lit("["), F.array_join("_rows", ","), F.lit("]")).alias("vulnerabilities"),
    )


def json_documents(reports: DataFrame) -> DataFrame:
    """(target, part, document): the JSON text of each report row."""
    metadata = F.to_json(
        F.struct(
            F.lit(TOOL).alias("tool_name"),
            F.lit(__version__).alias("tool_version"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scan_timestamp"),
            "target",
        )
    )
    document = F.concat(
        F.lit('{"scan_metadata":'), metadata, F.lit(',"summary":'), F.col("summary"),
        F.lit(',"vulnerabilities":'), F.col("vulnerabilities"), F.lit("}"),
    )
    return reports.select("target", "part", document.alias("document"))
