"""Files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.bytesx import utf8
from tamperlens.functions.paths import full_suffix
from tamperlens.rules import markers as M

KNOWN = [ext for ext, *_ in M.CATALOGUE]
# Suffixes that some detector takes although the catalogue does not list them.
ROUTED = sorted({t for tokens in M.ROUTES.values() for t in tokens if t.startswith(".")} | {".tar.bz2", ".json", ".txt"})


def artifacts(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of one file or a directory tree.

    The suffix filter runs on the listing; ``content`` is read only where a
    query uses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = KNOWN + ROUTED if extensions is None else extensions
    return files.where(full_suffix(F.col("path")).isin(*wanted)) if wanted else files


def texts_of(artifacts: DataFrame) -> DataFrame:
    """(path, source, text) with content read as UTF-8."""
    return artifacts.select("path", F.col("path").alias("source"), utf8(F.col("content")).alias("text"))


def byte_texts_of(artifacts: DataFrame) -> DataFrame:
    """(path, source, text) with one character per byte."""
    return artifacts.select("path", F.col("path").alias("source"), F.decode("content", "ISO-8859-1").alias("text"))
