"""JSON reports, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.operators.reports import json_documents, json_reports, sarif_documents

_SEVERITY = "struct<level:string,cvss_score:double,cvss_vector:string>"
REPORT = (
    "struct<id:string,scanner:string,vulnerability_type:string,"
    f"severity:{_SEVERITY},description:string,location:map<string,string>,"
    "evidence:map<string,string>,recommendation:string,references:array<string>,"
    "cwe_id:string,cve_id:string>"
)


def parse(documents: DataFrame) -> DataFrame:
    """Finding rows of documents: ``path`` and ``text``, a whole report each.

    A field that is missing takes the value a reader of such reports expects.
    """
    parsed = F.from_json("text", f"struct<vulnerabilities:array<{REPORT}>>")
    rows = documents.select("path", F.explode(parsed["vulnerabilities"]).alias("v")).select("path", "v.*")
    level = F.coalesce("severity.level", F.lit("Medium"))
    score = F.coalesce("severity.cvss_score", F.lit(5.0))
    return rows.select(
        "path",
        F.coalesce(F.col("location")["file"], "path").alias("source"),
        F.coalesce("scanner", F.lit("Unknown")).alias("scanner"),
        F.coalesce("vulnerability_type", F.lit("Unknown")).alias("vulnerability_type"),
        F.struct(
            level.alias("level"), score.alias("cvss_score"), F.coalesce("severity.cvss_vector", F.lit("")).alias("cvss_vector")
        ).alias("severity"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("location", F.create_map().cast("map<string,string>")).alias("location"),
        F.coalesce("evidence", F.create_map().cast("map<string,string>")).alias("evidence"),
        F.coalesce("recommendation", F.lit("")).alias("recommendation"),
        F.coalesce("references", F.array().cast("array<string>")).alias("references"),
        "cwe_id",
        "cve_id",
        F.coalesce("id", F.lit("UNKNOWN")).alias("finding_id"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Findings of every report file under a path, one document per file."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return parse(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def write_json(findings: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """One JSON document per line: target by target, in parts."""
    json_documents(json_reports(findings, **options)).select(F.col("document").alias("value")).write.mode(mode).text(path)


def write_sarif(findings: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """One SARIF document per line."""
    sarif_documents(findings, **options).select(F.col("document").alias("value")).write.mode(mode).text(path)


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """Findings as Parquet, split by level."""
    findings.withColumn("level", F.col("severity.level")).write.mode(mode).partitionBy("level").parquet(path)
