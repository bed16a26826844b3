"""CVSS 3.x base scores of a column of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.groups import small_table
from tamperlens.rules import markers as M

# Metric defaults.
DEFAULTS = {"AV": "N", "AC": "L", "PR": "N", "UI": "N", "S": "U", "C": "N", "I": "N", "A": "N"}


def components(vector: Column) -> Column:
    """STRUCT of the eight base metrics; a metric that is missing takes its default."""
    # A later value of the same metric wins, as when the parts are read in order.
    body = F.concat(F.lit("/"), F.regexp_replace(vector, r"^CVSS:3\.[01]/", ""))

    def metric(key: str, default: str) -> Column:
        value = F.regexp_extract(body, f"^.*/{key}:([^/]*)", 1)
        # An empty result is either an empty value or no value at all.
        return F.when(value != "", value).when(F.contains(body, F.lit(f"/{key}:")), "").otherwise(default)

    return F.struct(*[metric(key, value).alias(key) for key, value in DEFAULTS.items()])


def _weight(metric: Column, table: dict[str, float], default: float) -> Column:
    result = F.lit(default)
    for key, value in table.items():
        result = F.when(metric == key, value).otherwise(result)
    return result


def base_score(parts: Column) -> Column:
    w = M.CVSS_WEIGHTS
    changed = parts["S"] == "C"
    unchanged = parts["S"] == "U"
    privileges = F.when(changed, _weight(parts["PR"], w["PR_CHANGED"], 0.85)).otherwise(
        _weight(parts["PR"], w["PR"], 0.85)
    )
    ease = (
        F.lit(8.22)
        * _weight(parts["AV"], w["AV"], 0.85)
        * _weight(parts["AC"], w["AC"], 0.77)
        * privileges
        * _weight(parts["UI"], w["UI"], 0.85)
    )
    kept = F.lit(1.0)
    for metric in ("C", "I", "A"):
        kept = kept * (F.lit(1.0) - _weight(parts[metric], w["IMPACT"], 0.0))
    loss = F.lit(1.0) - kept
    impact = F.when(unchanged, F.lit(6.42) * loss).otherwise(
        F.lit(7.52) * (loss - 0.029) - F.lit(3.25) * F.pow(loss - 0.02, F.lit(15.0))
    )
    raw = F.when(unchanged, F.least(impact + ease, F.lit(10.0))).otherwise(
        F.least(F.lit(1.08) * (impact + ease), F.lit(10.0))
    )
    # Fixed value: nearest tenth, halves to even.
    return F.when(impact <= 0, 0.0).otherwise(F.rint(raw * 10) / 10)


def score_level(score: Column) -> Column:
    return (
        F.when(score >= 9.0, "Critical").when(score >= 7.0, "High").when(score >= 4.0, "Medium")
        .when(score > 0.0, "Low").otherwise("Info")
    )


def normal_vector(parts: Column) -> Column:
    cells = [F.concat(F.lit(f"{key}:"), parts[key]) for key in DEFAULTS]
    return F.concat_ws("/", F.lit("CVSS:3.1"), *cells)


def score(rows: DataFrame, vector: str = "cvss_vector") -> DataFrame:
    """Add ``score``, ``level`` and the normal form of each vector.

    The score is a short expression per row: computing it in place is cheaper
    than collecting distinct vectors and joining them back.
    """
    parts = F.col("_parts")
    return (
        rows.withColumn("_parts", components(F.col(vector)))
        .withColumn("score", base_score(parts))
        .withColumn("normal_vector", normal_vector(parts))
        .withColumn("level", score_level(F.col("score")))
        .drop("_parts")
    )


def presets(spark: SparkSession) -> DataFrame:
    return score(small_table(spark, M.CVSS_PRESETS, "preset string, cvss_vector string"))


# Lowest and highest score of each level.
def level_ranges(spark: SparkSession) -> DataFrame:
    rows = [("Critical", 9.0, 10.0), ("High", 7.0, 8.9), ("Medium", 4.0, 6.9), ("Low", 0.1, 3.9), ("Info", 0.0, 0.0)]
    return small_table(spark, rows, "level string, low double, high double")


def distribution(rows: DataFrame, vector: str = "cvss_vector") -> DataFrame:
    """Vectors and mean score per level.

    Equal vectors are counted together first: each is scored once, and a vector
    that makes up most of the rows is one row after the partial count.
    """
    counted = rows.groupBy(vector).agg(F.count(F.lit(1)).alias("n"))
    scored = score(counted, vector)
    return scored.groupBy("level").agg(
        F.sum("n").alias("vectors"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("mean_score")
    )
