"""GGUF headers, directories and embedded patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.functions.findings import as_findings, findings_of, hit, hits_if
from tamperlens.functions.groups import first_per_key
from tamperlens.functions.ordered import running_sum
from tamperlens.functions.text import first_match
from tamperlens.rules import markers as M
from tamperlens.rules import text_rules as R

SCANNER = "gguf"
_BIG = "decimal(38,0)"


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(_BIG)


def _is_marker(value: Column) -> Column:
    return value.cast(_BIG).isin(*[_number(v) for v in M.GGUF_MARKERS])


def _is_sign_marker(value: Column) -> Column:
    return value.cast(_BIG).isin(*[_number(v) for v in M.GGUF_SIGN_MARKERS])


def headers(artifacts: DataFrame) -> DataFrame:
    """(path, source, length, version, n_tensors, n_kv) of GGUF content."""
    content = F.col("content")
    return artifacts.where(B.starts_with(content, b"GGUF")).select(
        "path",
        F.col("path").alias("source"),
        F.coalesce(F.col("length"), F.octet_length(content).cast("bigint")).alias("length"),
        B.unsigned_le(content, 4, 4).cast("bigint").alias("version"),
        B.unsigned_le(content, 8, 8).alias("n_tensors"),
        B.unsigned_le(content, 16, 8).alias("n_kv"),
    )


def header_issues(artifacts: DataFrame) -> DataFrame:
    legacy = B.starts_with(F.col("content"), b"GGML")
    return artifacts.where(~B.starts_with(F.col("content"), b"GGUF")).select(
        "path",
        F.lit(SCANNER).alias("scanner"),
        F.when(legacy, "warning").otherwise("error").alias("kind"),
        F.when(legacy, "Legacy GGML format").otherwise("Not a GGUF file").alias("message"),
    )


def _hex(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.conv(value.cast("string"), 10, 16))


def header_columns(version: Column, n_tensors: Column, n_kv: Column, length: Column) -> Column:
    """Hits of the three header fields."""
    return F.concat(
        version_columns(version), tensor_count_columns(n_tensors, length), kv_count_columns(n_kv)
    )


def version_columns(version: Column) -> Column:
    low, high = M.GGUF_VERSIONS
    marker = _is_marker(version)
    far = version > 1000
    found = hit(
        SCANNER,
        F.when(marker, "GGUF - Version Corruption Exploit").otherwise("GGUF - Invalid Version"),
        F.when(marker, "Critical").when(far, "High").otherwise("Medium"),
        F.when(marker, 9.0).when(far, 7.5).otherwise(5.0),
        F.concat(F.lit("Version field is "), version.cast("string")),
        location={"offset": 4}, evidence={"value": version, "hex": _hex(version)}, cwe="CWE-20",
    )
    return hits_if((marker | ~version.between(low, high), found))


def tensor_count_columns(n_tensors: Column, length: Column) -> Column:
    """Marker, product overflow, too many, or too many for the file; the last two may both hold."""
    n = n_tensors.cast(_BIG)
    marker = _is_marker(n)
    overflow = ~marker & (n > _number(M.SIGNED_64_MAX // M.GGUF_TENSOR_STRUCT))
    plain = ~marker & ~overflow

    def case(test, kind, level, score, cwe, cve=None):
        return test, hit(
            SCANNER, kind, level, score,
            F.concat(F.lit("Header claims "), n.cast("string"), F.lit(" tensors")),
            location={"offset": 8}, evidence={"value": n, "file_size": length}, cwe=cwe, cve=cve,
        )

    cve = "CVE-2024-21836"
    return hits_if(
        case(marker, f"GGUF - Tensor Count Integer Overflow Exploit ({cve})", "Critical", 9.8, "CWE-190", cve),
        case(overflow, f"GGUF - Tensor Count Integer Overflow ({cve})", "Critical", 9.8, "CWE-190", cve),
        case(plain & (n > M.GGUF_MAX_COUNT), "GGUF - Excessive Tensor Count (DoS)", "High", 7.5, "CWE-400"),
        case(
            plain & (n * M.GGUF_TENSOR_BYTES > length.cast(_BIG) * 100),
            "GGUF - Tensor Count/File Size Mismatch", "High", 7.0, "CWE-20",
        ),
    )


def kv_count_columns(n_kv: Column) -> Column:
    marker = _is_marker(n_kv)
    found = hit(
        SCANNER,
        F.when(marker, "GGUF - Metadata Count Integer Overflow (DoS)").otherwise("GGUF - Excessive Metadata Count (DoS)"),
        F.when(marker, "Critical").otherwise("High"),
        F.when(marker, 9.0).otherwise(7.5),
        F.concat(F.lit("Header claims "), n_kv.cast("string"), F.lit(" metadata entries")),
        location={"offset": 16}, evidence={"value": n_kv}, cwe="CWE-400",
    )
    return hits_if((marker | (n_kv > M.GGUF_MAX_COUNT), found))


def version_check(headers: DataFrame) -> DataFrame:
    return findings_of(headers, version_columns(F.col("version")))


def tensor_count_check(headers: DataFrame) -> DataFrame:
    return findings_of(headers, tensor_count_columns(F.col("n_tensors"), F.col("length")))


def kv_count_check(headers: DataFrame) -> DataFrame:
    return findings_of(headers, kv_count_columns(F.col("n_kv")))


def _violation(test: Column, kind: str, level: str, score: float, cwe: str, value: Column, cve=None) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(kind).alias("kind"), F.lit(level).alias("level"), F.lit(score).alias("score"),
            F.lit(cwe).alias("cwe"), F.lit(cve).cast("string").alias("cve"), value.cast("string").alias("value"),
        ),
    )


def _first_violations(rows: DataFrame, checks: list[Column], index: str) -> DataFrame:
    """Directory checks stop at the first violation of a file."""
    hits = rows.withColumn("hit", F.coalesce(*checks)).where(F.col("hit").isNotNull())
    hits = hits.select("path", F.col("path").alias("source"), "idx", "offset", "hit.*")
    return as_findings(
        first_per_key(hits, ["path", "source"], ["idx"]),
        SCANNER, F.col("kind"), F.col("level"), F.col("score"),
        F.concat(F.lit(f"{index} "), F.col("idx").cast("string"), F.lit(": "), F.col("value")),
        location={"offset": F.col("offset"), index: F.col("idx")},
        evidence={"value": F.col("value"), "index": F.col("idx")},
        advice="Do not load with an unpatched parser.", cwe=F.col("cwe"), cve=F.col("cve"),
    )


def kv_checks(kv: DataFrame) -> DataFrame:
    """First violation in the metadata directory of each file."""
    key, text, array = F.col("key_len"), F.col("str_len"), F.col("arr_len")
    kind = F.col("value_type")
    checks = [
        _violation(_is_sign_marker(key), "GGUF - Signed/Unsigned Conversion Exploit", "Critical", 9.5, "CWE-195", key),
        _violation(_is_marker(key), "GGUF - Metadata String Length Exploit", "Critical", 9.5, "CWE-120", key),
        _violation(key > M.GGUF_MAX_STRING, "GGUF - Excessive Metadata Key Length", "High", 8.0, "CWE-120", key),
        _violation((kind < 0) | (kind > M.GGUF_MAX_TYPE), "GGUF - Invalid Metadata Type", "Medium", 6.0, "CWE-20", kind),
        _violation(
            (kind == M.GGUF_STRING) & _is_sign_marker(text),
            "GGUF - Token Length Signed Conversion Exploit", "Critical", 9.5, "CWE-195", text,
        ),
        _violation(
            (kind == M.GGUF_STRING) & _is_marker(text),
            "GGUF - Metadata String Value Length Exploit", "Critical", 9.0, "CWE-120", text,
        ),
        _violation(
            (kind == M.GGUF_ARRAY) & (_is_marker(array) | _is_sign_marker(array)),
            "GGUF - Metadata Array Length Exploit", "Critical", 9.0, "CWE-190", array,
        ),
        _violation(
            (kind == M.GGUF_ARRAY) & (array > M.GGUF_MAX_ARRAY),
            "GGUF - Excessive Array Length", "High", 7.5, "CWE-400", array,
        ),
        _violation(F.col("truncated"), "GGUF - Truncated Metadata", "Medium", 5.5, "CWE-20", F.lit("cut short")),
    ]
    return _first_violations(kv, checks, "metadata_index")


def _size(dims: Column) -> Column:
    """Product of the dimensions; held just above the signed 64-bit limit once past it."""
    limit = _number(M.SIGNED_64_MAX)
    over = (limit + 1).cast(_BIG)

    def multiply(total, dim):
        factor = F.greatest(dim.cast(_BIG), _number(1))
        # Compare by quotient: the product itself could pass 38 digits.
        fits = total <= F.floor(limit.cast("decimal(38,0)") / factor).cast(_BIG)
        return F.when(fits, (total * factor).cast(_BIG)).otherwise(over)

    return F.aggregate(dims, _number(1), multiply)


def _before_marker(dims: Column) -> Column:
    """The dimensions in front of the first marker value; all of them when there is none."""
    at = F.array_position(F.transform(dims, _is_marker), True)
    return F.when(at > 0, F.slice(dims, F.lit(1), (at - 1).cast("int"))).otherwise(dims)


def tensor_sizes(tensors: DataFrame) -> DataFrame:
    return tensors.withColumn("size", _size(F.coalesce("dims", F.array().cast("array<decimal(20,0)>"))))


def tensor_checks(tensors: DataFrame) -> DataFrame:
    """First violation in the tensor directory of each file."""
    name, dims = F.col("name_len"), F.col("n_dims")
    bad_dim = F.try_element_at(F.filter("dims", _is_marker), F.lit(1))
    checks = [
        _violation(_is_marker(name) | _is_sign_marker(name), "GGUF - Tensor Name Length Exploit", "Critical", 9.0, "CWE-120", name),
        _violation(name > M.GGUF_MAX_STRING, "GGUF - Excessive Tensor Name Length", "High", 7.5, "CWE-120", name),
        _violation(
            dims > M.GGUF_MAX_DIMS, "GGUF - Tensor Dimension Overflow (CVE-2024-21802)", "Critical", 9.0,
            "CWE-122", dims, "CVE-2024-21802",
        ),
        # Dimensions are judged in order: an overflow in front of a marker comes first.
        _violation(
            _size(_before_marker(F.coalesce("dims", F.array().cast("array<decimal(20,0)>")))) > _number(M.SIGNED_64_MAX),
            "GGUF - Integer Overflow in Tensor Size", "Critical", 9.0, "CWE-190", F.lit("size overflow"), "CVE-2025-53630",
        ),
        _violation(bad_dim.isNotNull(), "GGUF - Tensor Dimension Exploit Value", "Critical", 9.0, "CWE-190", bad_dim),
    ]
    return _first_violations(tensors, checks, "tensor_index")


def cumulative(sizes: DataFrame) -> DataFrame:
    """First tensor at which the running total of sizes passes the signed 64-bit limit."""
    limit = _number(M.SIGNED_64_MAX)
    total = running_sum(sizes, ["path"], "idx", F.col("size").cast("decimal(28,0)"), "running")
    rows = first_per_key(total.where(F.col("running") > limit), ["path"], ["idx"]).withColumn("source", F.col("path"))
    return as_findings(
        rows, SCANNER, "GGUF - Cumulative Size Integer Overflow", "Critical", 9.0,
        F.concat(F.lit("Sizes overflow at tensor "), F.col("idx").cast("string")),
        location={"tensor_index": F.col("idx")},
        evidence={"index": F.col("idx"), "value": F.col("running")}, cwe="CWE-190",
    )


def _template_pattern(literal: str) -> str:
    """Regular expression of one pattern; the second part must end within the window."""
    if ".*" not in literal:
        return re.escape(literal)
    first, second = literal.split(".*")
    gap = R.TEMPLATE_WINDOW - len(first) - len(second)
    return f"{re.escape(first)}[\\s\\S]{{0,{gap}}}?{re.escape(second)}"


def _view(texts: DataFrame) -> DataFrame:
    """``text`` for rows of text, or the byte view of ``content``."""
    if "text" in texts.columns:
        return texts
    return texts.withColumn("source", F.col("path")).withColumn("text", B.latin1(F.col("content")))


def template_match(text: Column) -> Column:
    """STRUCT<rule, pattern, offset> of the first pattern, in rule order, that occurs."""
    tests = []
    for number, literal in enumerate(R.TEMPLATE_INJECTION):
        anchor = max(literal.split(".*"), key=len)
        pattern = _template_pattern(literal)
        found = F.contains(text, F.lit(anchor)) & F.rlike(text, F.lit(pattern))
        # The offset is the length of what precedes the first match.
        before = F.length(F.regexp_extract(text, f"^([\\s\\S]*?){pattern}", 1))
        tests.append(
            (found, F.struct(F.lit(number).alias("rule"), F.lit(literal).alias("pattern"), before.alias("offset")))
        )
    return first_match(tests)


def template_context(text: Column, match: Column) -> Column:
    return F.substr(text, F.greatest(match["offset"] - 49, F.lit(1)), F.lit(200))


def template_hit(pattern: Column, place: Column, context: Column) -> Column:
    return hit(
        SCANNER, "GGUF - Jinja2 SSTI Remote Code Execution", "Critical", 10.0,
        F.concat(F.lit("Template holds "), pattern),
        location={"offset": place},
        evidence={"pattern": pattern, "offset": place, "context": context},
        advice="Do not render this template.",
        references=["https://nvd.nist.gov/vuln/detail/CVE-2024-25123"],
        cwe="CWE-94", cve="CVE-2024-25123",
    )


def _template_hit(text: Column, match: Column, start: Column) -> Column:
    return template_hit(match["pattern"], start + match["offset"], template_context(text, match))


def template_columns(text: Column) -> Column:
    found = F.array_compact(F.array(template_match(text)))
    return F.transform(found, lambda m: _template_hit(text, m, F.lit(0).cast("bigint")))


def template_injection(texts: DataFrame) -> DataFrame:
    """First template-injection pattern of every source, with its offset and context.

    Chunks of a file (rows with ``start``) give the first rule at its first place.
    """
    view = _view(texts)
    if "start" not in view.columns:
        return findings_of(view, template_columns(F.col("text")))
    rows = view.withColumn("match", template_match(F.col("text"))).where(F.col("match").isNotNull())
    rows = first_per_key(
        rows.withColumns({"_rule": F.col("match.rule"), "_at": F.col("start") + F.col("match.offset")}),
        ["path", "source"], ["_rule", "_at"],
    )
    return findings_of(rows, F.array(_template_hit(F.col("text"), F.col("match"), F.col("start"))))


def traversal_test(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(f"(?i){pattern}"))


def traversal_hit(pattern: str) -> Column:
    return hit(SCANNER, "GGUF - Path Traversal in Metadata", "High", 8.0, f"Metadata holds {pattern}", evidence={"pattern": pattern}, cwe="CWE-22")


def traversal_columns(text: Column) -> Column:
    return hits_if(*[(traversal_test(text, p), traversal_hit(p)) for p in R.PATH_TRAVERSAL])


def path_traversal(texts: DataFrame) -> DataFrame:
    """One finding per path-traversal pattern and source."""
    view = _view(texts)
    found = findings_of(view, traversal_columns(F.col("text")))
    return found.dropDuplicates(["finding_id"]) if "start" in view.columns else found


def marker_hit(raw: bytes, kind: str, offset: Column) -> Column:
    severe = "CVE" in kind or "Overflow" in kind
    return hit(
        SCANNER, kind, "Critical" if severe else "High", 9.5 if severe else 8.0,
        F.concat(F.lit(f"Bytes {raw.hex()} at "), offset.cast("string")),
        location={"offset": offset},
        evidence={"pattern_hex": raw.hex(), "offset": offset, "weak_signature": str(len(raw) < 8).lower()},
        cwe="CWE-190",
    )


def marker_columns(text: Column) -> Column:
    """Hits of the byte signatures in a byte view, each at its first offset."""
    tests = []
    for raw, kind, _ in M.GGUF_BYTE_MARKERS:
        at = B.find_offset(text, raw)
        tests.append((at.isNotNull(), marker_hit(raw, kind, at)))
    return hits_if(*tests)


def byte_markers(artifacts: DataFrame) -> DataFrame:
    """Findings of byte signatures in whole contents."""
    view = _view(artifacts.select("path", "content")).withColumn("start", F.lit(0).cast("bigint"))
    return _lowest_markers(view, range(len(M.GGUF_BYTE_MARKERS)))


def chunk_byte_markers(chunk_texts: DataFrame) -> DataFrame:
    """All byte signatures over chunks, each at its lowest offset."""
    return _lowest_markers(chunk_texts, range(len(M.GGUF_BYTE_MARKERS)))


def _lowest_markers(views: DataFrame, markers) -> DataFrame:
    """Each signature at its lowest offset in its file; only hits are shuffled."""
    places = [
        F.struct(F.lit(i).alias("marker"), (F.col("start") + B.find_offset(F.col("text"), M.GGUF_BYTE_MARKERS[i][0])).alias("at"))
        for i in markers
    ]
    lowest = (
        views.select("path", "source", F.explode(F.filter(F.array(*places), lambda p: p["at"].isNotNull())).alias("p"))
        .groupBy("path", "source", F.col("p.marker").alias("marker"))
        .agg(F.min("p.at").alias("at"))
    )
    found = [
        (F.col("marker") == i, marker_hit(raw, kind, F.col("at")))
        for i, (raw, kind, _) in enumerate(M.GGUF_BYTE_MARKERS)
    ]
    return findings_of(lowest, hits_if(*found))


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """Texts of chunks with their overlap, so that a match may cross a boundary."""
    return chunks.select(
        "path", F.col("path").alias("source"), F.col("offset").alias("start"),
        B.latin1(F.concat("bytes", "halo")).alias("text"),
    )
