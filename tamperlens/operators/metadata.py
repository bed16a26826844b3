"""Metadata fields and headers."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.functions.findings import as_findings, findings_of, hit, hits_if
from tamperlens.functions.groups import fixed
from tamperlens.functions.text import first_match
from tamperlens.operators import jsonwalk
from tamperlens.rules import text_rules as R
from tamperlens.schema import SAFETENSORS_HEADERS
from tamperlens.sources.paged import Pages, per_file

SCANNER = "metadata"
# Limits in bytes.
MAX_FIELD = 100_000
MAX_HEADER = 100 * 1024 * 1024
HEADER_WINDOW = 1024 * 1024


def json_fields(texts: DataFrame, depth: int | None = None) -> DataFrame:
    """String values of object members: (path, source, json_path, name, value).

    Strings that stand directly in lists are not fields.
    """
    rows = jsonwalk.leaves(texts, depth)
    kept = rows.where(~F.col("open") & F.col("name").isNotNull() & F.col("value").isNotNull())
    return kept.select("path", "source", "json_path", "name", "value")


def _length_hit() -> Column:
    return hit(
        SCANNER, "Metadata - Excessive Length", "Medium", 5.5,
        F.concat(F.lit("Field "), F.col("name"), F.lit(" has "), F.col("length").cast("string"), F.lit(" bytes")),
        evidence={"field": F.col("name"), "length": F.col("length")}, cwe="CWE-120",
    )


def _format_hit() -> Column:
    return hit(
        SCANNER, "Metadata - Format String", "Medium", 6.0,
        F.concat(F.lit("Field "), F.col("name"), F.lit(" holds a printf directive")),
        evidence={"field": F.col("name"), "pattern": F.col("pattern")}, cwe="CWE-134",
    )


def _script_hit() -> Column:
    preview = B.utf8(F.substring(F.encode("value", "UTF-8"), 1, 200))
    return hit(
        SCANNER, "Metadata - Embedded Script", "High", 7.0,
        F.concat(F.lit("Field "), F.col("name"), F.lit(" holds "), F.col("script_type")),
        evidence={"field": F.col("name"), "script_type": F.col("script_type"), "preview": preview},
        cwe="CWE-79",
    )


def _length() -> Column:
    return F.octet_length("value")


def _format() -> Column:
    return F.when(F.contains("value", F.lit("%")), first_match([(F.rlike("value", F.lit(p)), p) for p in R.FORMAT_STRINGS]))


def _script() -> Column:
    return first_match([(F.rlike("value", F.lit(f"(?i){p}")), d) for p, d in R.SCRIPTS])


def field_length(fields: DataFrame, limit: int = MAX_FIELD) -> DataFrame:
    return findings_of(fields.withColumn("length", _length()).where(F.col("length") > limit), F.array(_length_hit()))


def format_string(fields: DataFrame) -> DataFrame:
    return findings_of(fixed(fields, pattern=_format()).where(F.col("pattern").isNotNull()), F.array(_format_hit()))


def embedded_script(fields: DataFrame) -> DataFrame:
    return findings_of(fixed(fields, script_type=_script()).where(F.col("script_type").isNotNull()), F.array(_script_hit()))


def field_findings(fields: DataFrame) -> DataFrame:
    """All findings of fields, by one pass over them."""
    rows = fixed(fields, length=_length(), pattern=_format(), script_type=_script())
    tests = ((F.col("length") > MAX_FIELD, _length_hit()), (F.col("pattern").isNotNull(), _format_hit()), (F.col("script_type").isNotNull(), _script_hit()))
    return findings_of(rows, hits_if(*tests))


def _header_of(path: str, data: Pages | bytes) -> Iterator[tuple]:
    if len(data) >= 8:
        size = int.from_bytes(data[:8], "little")
        yield path, Decimal(size), data[8 : 8 + size].decode("utf-8", "replace") if size <= MAX_HEADER else None


def safetensors_headers(artifacts: DataFrame) -> DataFrame:
    """(path, source, header_size, text): the header as JSON text, NULL when oversized.

    The size is read from the first 8 bytes; a header is decoded whole. Without a
    ``content`` column it is read from the file by its path.
    """
    if "content" not in artifacts.columns:
        found = per_file(artifacts, _header_of, SAFETENSORS_HEADERS)
        return found.select("path", F.col("path").alias("source"), "header_size", "text")
    size = B.unsigned_le(F.col("content"), 0, 8)
    window = F.least(F.col("header_size"), F.lit(MAX_HEADER)).cast("int")
    return (
        fixed(artifacts.withColumn("source", F.col("path")), header_size=size)
        .where(F.col("header_size").isNotNull())
        .select(
            "path",
            "source",
            "header_size",
            F.when(
                F.col("header_size") <= MAX_HEADER, B.utf8(F.substr("content", F.lit(9), window))
            ).alias("text"),
        )
    )


def safetensors_findings(artifacts: DataFrame) -> DataFrame:
    headers = safetensors_headers(artifacts)
    oversized = as_findings(
        headers.where(F.col("header_size") > MAX_HEADER),
        SCANNER, "Metadata - Excessive Header Size", "Medium", 5.0,
        F.concat(F.lit("Header of "), F.col("header_size").cast("string"), F.lit(" bytes")),
        evidence={"header_size": F.col("header_size")}, cwe="CWE-400",
    )
    fields = json_fields(headers.where(F.col("text").isNotNull()))
    return oversized.unionByName(field_findings(fields))


def _window(content: Column, window: int | None) -> Column:
    return content if window is None else F.substring(content, 1, window)


def long_segment_columns(text: Column, limit: int = MAX_FIELD) -> Column:
    """The first long, mostly printable run between NUL bytes of a byte view."""
    printable = lambda t: F.length(F.regexp_replace(t, "[^ -~]", ""))
    segments = F.transform(
        F.split(text, "\x00"),
        lambda piece, i: F.struct(i.cast("bigint").alias("index"), piece.alias("text")),
    )
    textual = F.filter(
        segments, lambda s: (F.length(s["text"]) > limit) & (printable(s["text"]) / F.length(s["text"]) > 0.7)
    )
    return F.transform(
        F.slice(textual, 1, 1),
        lambda s: hit(
            SCANNER, "Metadata - Long Text Segment", "Low", 3.5,
            F.concat(F.length(s["text"]).cast("string"), F.lit(" bytes of text without a break")),
            location={"segment_index": s["index"]},
            evidence={"length": F.length(s["text"]), "preview": F.substring(s["text"], 1, 100)}, cwe="CWE-120",
        ),
    )


def code_pattern_columns(text: Column) -> Column:
    """The first script marker in a byte view, with how often it occurs."""
    found = [
        (
            F.rlike(text, F.lit(f"(?i){p}")),
            hit(
                SCANNER, "Metadata - Embedded Code Pattern", "Medium", 5.0, f"Content holds {d}",
                evidence={"pattern_type": d, "count": F.regexp_count(text, F.lit(f"(?i){p}"))}, cwe="CWE-94",
            ),
        )
        for p, d in R.SCRIPTS
    ]
    return F.array_compact(F.array(first_match(found)))


def _viewed(artifacts: DataFrame, window: int | None) -> DataFrame:
    view = B.latin1(_window(F.col("content"), window)).alias("_text")
    return artifacts.select("path", F.col("path").alias("source"), view)


def long_segment(artifacts: DataFrame, window: int | None = HEADER_WINDOW, limit: int = MAX_FIELD) -> DataFrame:
    """Findings of long segments; ``window=None`` reads whole contents."""
    return findings_of(_viewed(artifacts, window), long_segment_columns(F.col("_text"), limit))


def code_pattern(artifacts: DataFrame, window: int | None = HEADER_WINDOW) -> DataFrame:
    """Findings of script markers; ``window=None`` reads whole contents."""
    return findings_of(_viewed(artifacts, window), code_pattern_columns(F.col("_text")))
