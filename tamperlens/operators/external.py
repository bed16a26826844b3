"""Findings of two other tools, read from their JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.findings import as_findings
from tamperlens.rules import markers as M

_LEVELS = {"CRITICAL": "Critical", "HIGH": "High", "MEDIUM": "Medium"}
_ISSUE = "struct<module:string,operator:string,source:string,description:string,scanner:string>"
# Fixed value: weakness class when a module or rule has none of its own.
_DEFAULT_MODEL_CWE, _DEFAULT_PACKAGE_CWE = "CWE-502", "CWE-1357"


def _lookup(key: Column, table: dict, default) -> Column:
    cells = []
    for name, value in table.items():
        cells += [F.lit(name), F.lit(value)]
    return F.coalesce(F.try_element_at(F.create_map(*cells), key), F.lit(default))


def modelscan(reports: DataFrame) -> DataFrame:
    """``reports`` has ``path`` and ``text``, the JSON report with issues by severity."""
    parsed = F.from_json("text", f"struct<issues_by_severity:map<string,array<{_ISSUE}>>>")
    issues = (
        reports.select("path", F.explode(parsed["issues_by_severity"]).alias("word", "issues"))
        .select("path", "word", F.explode("issues").alias("issue"))
        .select(
            "path",
            "word",
            F.coalesce("issue.module", F.lit("unknown")).alias("module"),
            F.coalesce("issue.operator", F.lit("unknown")).alias("operator"),
            F.coalesce("issue.source", "path").alias("source"),
            F.coalesce("issue.description", F.concat(F.lit("Unsafe operator "), F.coalesce("issue.operator", F.lit("unknown")))).alias("text"),
        )
    )
    return as_findings(
        issues, "modelscan",
        F.concat(F.lit("ModelScan - Unsafe Operator ("), F.col("word"), F.lit(")")),
        _lookup(F.col("word"), _LEVELS, "Low"),
        _lookup(F.col("word"), M.MODELSCAN_SCORES, 5.5),
        F.col("text"),
        evidence={"module": F.col("module"), "operator": F.col("operator")},
        advice="Do not load; ask for safetensors.",
        cwe=_lookup(F.col("module"), M.MODELSCAN_CWE, _DEFAULT_MODEL_CWE),
    )


def _guarddog_objects(reports: DataFrame) -> DataFrame:
    """One row per report object: a report is an object or a list of them."""
    fields = "struct<results:map<string,string>,errors:array<string>,issues:array<string>>"
    one = F.from_json("text", fields)
    many = F.from_json("text", f"array<{fields}>")
    listed = F.startswith(F.ltrim("text"), F.lit("["))
    return reports.select("path", F.explode(F.when(listed, many).otherwise(F.array(one))).alias("report"))


def guarddog(reports: DataFrame) -> DataFrame:
    """Rules with results, and single issues, of each report."""
    objects = _guarddog_objects(reports)
    filled = ~F.coalesce(F.col("result"), F.lit("")).isin("", "[]", "{}", "null", "false", "0")
    by_rule = (
        objects.select("path", F.explode("report.results").alias("rule", "result"))
        .where(filled)
        .select("path", "rule", F.lit(None).cast("string").alias("message"))
    )
    field = lambda key: F.get_json_object("issue", f"$.{key}")
    by_issue = objects.select("path", F.explode("report.issues").alias("issue")).select(
        "path",
        F.coalesce(field("rule"), field("code"), F.lit("unknown")).alias("rule"),
        F.coalesce(field("message"), field("description")).alias("message"),
    )
    rows = by_rule.unionByName(by_issue).withColumn("source", F.col("path"))
    word = F.col("word")
    rows = rows.withColumn("word", _lookup(F.col("rule"), M.GUARDDOG_LEVELS, "MEDIUM"))
    return as_findings(
        rows, "guarddog",
        F.concat(F.lit("GuardDog - "), F.col("rule")),
        _lookup(word, _LEVELS, "Low"),
        _lookup(word, M.GUARDDOG_SCORES, 5.5),
        F.coalesce("message", F.concat(F.lit("Package rule fired: "), F.col("rule"))),
        evidence={"rule": F.col("rule")},
        advice="Review this package before installing it.",
        cwe=_lookup(F.col("rule"), M.GUARDDOG_CWE, _DEFAULT_PACKAGE_CWE),
    )


def guarddog_issues(reports: DataFrame) -> DataFrame:
    return _guarddog_objects(reports).select("path", F.explode("report.errors").alias("message")).select(
        "path", F.lit("guarddog").alias("scanner"), F.lit("warning").alias("kind"), "message"
    )
