"""Files that pass for more than one format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.functions.findings import as_findings, findings_of, hit, hits_if
from tamperlens.functions.paths import extension
from tamperlens.rules import markers as M

_SCANNER, _CWE = "polyglot", "CWE-434"
_FORMATS = [name for name, _ in M.SIGNATURES]


def signature_formats(content: Column) -> Column:
    """Sorted formats whose signature opens the content."""
    tests = []
    for name, signatures in M.SIGNATURES:
        hit = F.lit(False)
        for raw in signatures:
            hit = hit | B.starts_with(content, raw)
        tests.append(F.when(hit, name))
    return F.array_sort(F.array_compact(F.array(*tests)))


def with_signatures(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn("source", F.col("path")).withColumn(
        "formats", signature_formats(F.substring("content", 1, 32))
    )


def claimed_format(ext: Column) -> Column:
    cells = []
    for key, value in M.CLAIMED_FORMATS.items():
        cells += [F.lit(key), F.lit(value)]
    return F.try_element_at(F.create_map(*cells), ext)


def _weak(format_name: Column) -> Column:
    return format_name.isin(M.WEAK_SIGNATURES).cast("string")


def mismatch_columns(path: Column, content: Column, formats: Column) -> Column:
    ext = extension(path)
    claimed = claimed_format(ext)
    test = claimed.isNotNull() & (F.size(formats) > 0) & ~F.array_contains(formats, claimed)
    listed = F.array_join(formats, ",")
    found = hit(
        _SCANNER, "Polyglot - Format Mismatch", "Medium", 6.0,
        F.concat(F.lit("Suffix says "), claimed, F.lit(", content says "), listed),
        evidence={
            "extension": ext,
            "claimed_format": claimed,
            "detected_formats": listed,
            "magic_bytes": F.lower(F.hex(F.substring(content, 1, 16))),
        },
        cwe=_CWE,
    )
    return hits_if((test, found))


def multiple_columns(formats: Column) -> Column:
    listed = F.array_join(formats, ",")
    found = hit(
        _SCANNER, "Polyglot - Multiple Format Signatures", "Medium", 5.5,
        F.concat(F.lit("Content opens like "), listed), evidence={"detected_formats": listed}, cwe=_CWE,
    )
    return hits_if((F.size(formats) > 1, found))


# Where foreign signatures are sought, in bytes.
SEARCH_FROM, SEARCH_HEAD, SEARCH_TAIL = 64, 64 * 1024, 1024


def embedded_columns(head: Column, tail: Column, formats: Column) -> Column:
    """Hits of foreign signatures in the byte view of the head, else of the tail."""
    tests = []
    for name, signatures in M.SIGNATURES:
        places = []
        for raw in signatures:
            first = B.find_offset(head, raw, SEARCH_FROM)
            last = B.find_offset(tail, raw)
            places += [first.cast("string"), F.concat(F.lit("tail+"), last.cast("string"))]
        place = F.coalesce(*places)
        risky = name in M.RISKY_EMBEDDED
        found = hit(
            _SCANNER, "Polyglot - Embedded Format", "High" if risky else "Medium", 7.5 if risky else 5.0,
            F.concat(F.lit(f"Content holds {name} at "), place),
            location={"offset": place},
            evidence={
                "primary_format": F.coalesce(F.try_element_at(formats, F.lit(1)), F.lit("unknown")),
                "embedded_format": name,
                "offset": place,
                "weak_signature": str(name in M.WEAK_SIGNATURES).lower(),
            },
            cwe=_CWE,
        )
        tests.append((~F.array_contains(formats, name) & place.isNotNull(), found))
    return hits_if(*tests)


def _behind_picture(text: Column, formats: Column) -> Column:
    """Byte view of what follows the end marker of a picture; NULL for other files."""
    has = lambda name: F.array_contains(formats, name)
    after_last = lambda raw: F.substring_index(text, raw.decode("latin-1"), -1)
    iend = F.locate("IEND", text)
    return (
        F.when(has("jpeg"), F.when(F.contains(text, B.literal_text(b"\xff\xd9")), after_last(b"\xff\xd9")))
        .when(has("png"), F.when(iend > 0, F.substr(text, iend + 8)))
        .when(has("gif"), F.when(F.contains(text, F.lit(";")), after_last(b";")))
    )


def trailing_columns(text: Column, formats: Column) -> Column:
    """A hit for over 10 bytes behind the end marker of a picture."""
    rest = F.filter(F.array(_behind_picture(text, formats)), lambda r: F.length(r) > 10)
    named = F.transform(
        rest,
        lambda r: F.struct(
            format_of(F.substring(r, 1, 32)).alias("format"),
            F.length(r).alias("size"),
        ),
    )

    return F.transform(named, lambda t: trailing_hit(t["format"], t["size"]))


def trailing_hit(kind: Column, size: Column) -> Column:
    risky = kind.isin(M.RISKY_TRAILING)
    return hit(
        _SCANNER, "Polyglot - Trailing Data", F.when(risky, "High").otherwise("Medium"),
        F.when(risky, 7.0).otherwise(5.5),
        F.concat(size.cast("string"), F.lit(" bytes follow the picture")),
        evidence={"trailing_format": kind, "trailing_size": size, "weak_signature": _weak(kind)},
        cwe=_CWE,
    )


def picture_ends(own: Column, behind: Column, formats: Column) -> Column:
    """End marker of a picture in a chunk: STRUCT<format, at, text> of where data may follow, counted from the chunk, and what does.

    ``own`` is the byte view of the chunk's own bytes and a few more, ``behind`` that of all that was read. The last marker of a JPEG
    or GIF counts, the first one of a PNG.
    """
    has = lambda name: F.array_contains(formats, name)

    def place(name: str, at: Column) -> Column:
        return F.when(has(name) & at.isNotNull(), F.struct(F.lit(name).alias("format"), at.cast("bigint").alias("at"), F.substr(behind, at.cast("int") + 1, F.lit(32)).alias("text")))

    def last(raw: bytes) -> Column:
        held = F.contains(own, B.literal_text(raw))
        return F.when(held, F.length(own) - F.length(F.substring_index(own, raw.decode("latin-1"), -1)))

    first = F.locate("IEND", own)
    return F.array_compact(
        F.array(
            F.when(has("jpeg"), place("jpeg", last(b"\xff\xd9"))).when(has("png"), place("png", F.when(first > 0, first + 7))).when(has("gif"), place("gif", last(b";")))
        )
    )


def format_of(opening: Column) -> Column:
    """Name of the format that a byte view opens like, or ``unknown``."""
    return F.coalesce(F.try_element_at(signature_formats(F.encode(opening, "ISO-8859-1")), F.lit(1)), F.lit("unknown"))


def mismatch(signed: DataFrame) -> DataFrame:
    """Findings of suffixes that the content contradicts."""
    return findings_of(signed, mismatch_columns(F.col("path"), F.col("content"), F.col("formats")))


def multiple(signed: DataFrame) -> DataFrame:
    """Findings of contents that open like several formats."""
    return findings_of(signed, multiple_columns(F.col("formats")))


def embedded(signed: DataFrame) -> DataFrame:
    """Findings of foreign signatures inside files."""
    views = signed.select(
        "path", "source", "formats",
        B.latin1(F.substring("content", 1, SEARCH_HEAD)).alias("_head"),
        B.latin1(F.right(F.col("content"), F.lit(SEARCH_TAIL))).alias("_tail"),
    )
    return findings_of(views, embedded_columns(F.col("_head"), F.col("_tail"), F.col("formats")))


def trailing(signed: DataFrame) -> DataFrame:
    """Findings of data behind pictures."""
    pictures = signed.where(F.arrays_overlap("formats", F.array(*[F.lit(p) for p in ("jpeg", "png", "gif")])))
    views = pictures.select("path", "source", "formats", B.latin1(F.col("content")).alias("_text"))
    return findings_of(views, trailing_columns(F.col("_text"), F.col("formats")))


def pytorch_variants(members: DataFrame) -> DataFrame:
    """(path, variant) for each PyTorch container layout the member names fit."""
    name = F.substring_index("entry", "/", -1)
    has = lambda test: F.bool_or(test)
    seen = members.groupBy("path").agg(
        has(F.col("origin") == "tar").alias("tar"),
        has(name == "data.pkl").alias("data"),
        has(name == "constants.pkl").alias("constants"),
        has(name == "attributes.pkl").alias("attributes"),
        has(name == "model.json").alias("json"),
        has(name == "version").alias("version"),
        has(F.endswith("entry", F.lit(".py"))).alias("code"),
        has(F.endswith("entry", F.lit(".pkl"))).alias("pickles"),
        has(name == "sys_info").alias("sys_info"),
        has(name == "storages").alias("storages"),
        has(name == "tensors").alias("tensors"),
        has(name == "pickle").alias("pickle"),
    )
    zipped = ~F.col("tar")
    tests = {
        "PyTorch v0.1.1": F.col("tar") & F.col("sys_info") & F.col("storages") & F.col("tensors") & F.col("pickle"),
        "TorchScript v1.0": zipped & F.col("json"),
        "TorchScript v1.1": zipped & F.col("json") & F.col("attributes"),
        "TorchScript v1.3": zipped & F.col("data") & F.col("constants"),
        "TorchScript v1.4": zipped & F.col("data") & F.col("constants") & F.col("version"),
        "PyTorch v1.3": zipped & F.col("data"),
        "PyTorch model archive format": zipped & F.col("code") & F.col("pickles"),
    }
    found = F.array_compact(F.array(*[F.when(test, variant) for variant, test in tests.items()]))
    return seen.select("path", F.explode(found).alias("variant"))


def pytorch_findings(members: DataFrame) -> DataFrame:
    """Containers that fit several layouts, or a legacy one."""
    legacy = [name for name, old in M.PYTORCH_VARIANTS if old]
    variants = pytorch_variants(members)
    # At most one row per documented layout, so the lists stay short.
    per_file = variants.groupBy("path").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    several = as_findings(
        per_file.where(F.size("variants") > 1).withColumn("source", F.col("path")),
        _SCANNER,
        "Polyglot - Multiple PyTorch Formats",
        "High",
        7.0,
        F.concat(F.lit("Members fit "), F.array_join("variants", ", ")),
        evidence={"pytorch_formats": F.array_join("variants", ",")},
        cwe=_CWE,
    )
    old = as_findings(
        variants.where(F.col("variant").isin(legacy)).withColumn("source", F.col("path")),
        _SCANNER,
        "Polyglot - Legacy PyTorch Format",
        "Medium",
        5.0,
        F.concat(F.lit("Members fit the legacy layout "), F.col("variant")),
        evidence={"pytorch_formats": F.col("variant")},
        cwe=_CWE,
    )
    return several.unionByName(old)


def polyglot_findings(artifacts: DataFrame) -> DataFrame:
    signed = with_signatures(artifacts)
    return (
        mismatch(signed).unionByName(multiple(signed)).unionByName(embedded(signed)).unionByName(trailing(signed))
    )
