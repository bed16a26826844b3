"""Format identification and routing of artifacts to detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.functions.paths import base_name, extension, full_suffix, parent_dir
from tamperlens.functions.text import first_match
from tamperlens.functions.groups import small_table
from tamperlens.rules import markers as M


def catalogue(spark: SparkSession) -> DataFrame:
    """The format table: one row per extension."""
    return small_table(
        spark, [(i, *row) for i, row in enumerate(M.CATALOGUE)],
        "position int, extension string, name string, framework string, "
        "is_archive boolean, can_execute_code boolean",
    )


def catalogue_formats(spark: SparkSession) -> DataFrame:
    """Distinct formats, described by the first extension that has them."""
    return (
        catalogue(spark)
        .groupBy("name")
        .agg(
            F.min_by("extension", "position").alias("extension"),
            F.min_by("framework", "position").alias("framework"),
            F.min_by("is_archive", "position").alias("is_archive"),
            F.min_by("can_execute_code", "position").alias("can_execute_code"),
        )
    )


def magic_format(content: Column) -> Column:
    """Format by leading bytes, NULL if none fits."""
    head = F.substring(content, 1, 16)
    return first_match([(B.starts_with(head, raw), name) for raw, name in M.MAGIC])


def _lookup(keys: Column, table: dict) -> Column:
    cells = []
    for key, value in table.items():
        cells += [F.lit(key), F.lit(value)]
    return F.try_element_at(F.create_map(*cells), keys)


def resolved_format(path: Column, magic: Column) -> Column:
    """Name by compound suffix, else by magic unless the suffix explains it, else by suffix."""
    suffix = full_suffix(path)
    named = _lookup(suffix, {ext: name for ext, name, *_ in M.CATALOGUE})
    expected = (suffix.isin(".pth", ".pt", ".keras") & (magic == "zip")) | (
        suffix.isin(".h5", ".hdf5") & (magic == "hdf5")
    )
    return (
        F.when(suffix == ".tar.gz", "tar_gzip")
        .when(suffix == ".tar.bz2", "tar_bzip2")
        .when(expected, named)
        .otherwise(F.coalesce(magic, named, F.lit("unknown")))
    )


def can_execute(format_name: Column) -> Column:
    """Code-execution flag of a format; an unknown format counts as able to."""
    flags: dict[str, bool] = {}
    for _, name, _, _, flag in M.CATALOGUE:
        flags.setdefault(name, flag)
    return F.coalesce(_lookup(format_name, flags), F.lit(True))


def archive_kind(path: Column, magic: Column) -> Column:
    """How the archive rules open a file; NULL when they cannot."""
    lowered, suffix = F.lower(path), full_suffix(path)
    return (
        F.when(F.endswith(lowered, F.lit(".tar.gz")) | F.endswith(lowered, F.lit(".tgz")), "tar:gz")
        .when(suffix == ".tar.bz2", "tar:bz2")
        .when(suffix == ".tar", "tar")
        .when(suffix.isin(".zip", ".npz", ".keras", ".pth", ".pt", ".whl"), "zip")
        .when(magic == "zip", "zip")
    )


def resolve(artifacts: DataFrame) -> DataFrame:
    """Add ``extension``, ``magic``, ``format``, ``archive_kind`` and ``can_execute_code``."""
    return (
        artifacts.withColumn("extension", full_suffix(F.col("path")))
        .withColumn("magic", magic_format(F.col("content")))
        .withColumn("format", resolved_format(F.col("path"), F.col("magic")))
        .withColumn("archive_kind", archive_kind(F.col("path"), F.col("magic")))
        .withColumn("can_execute_code", can_execute(F.col("format")))
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """Issues for artifacts the archive rules were asked to read but cannot open."""
    return resolved.where(F.col("archive_kind").isNull() & (F.col("format") == "unknown")).select(
        "path",
        F.lit("zip_slip").alias("scanner"),
        F.lit("warning").alias("kind"),
        F.lit("Archive format could not be determined").alias("message"),
    )


def directory_formats(paths: DataFrame) -> DataFrame:
    """Kind of every directory, from the names of the files in it."""
    name = base_name(F.col("path"))
    return (
        paths.select(parent_dir(F.col("path")).alias("directory"), name.alias("name"))
        .groupBy("directory")
        .agg(
            F.bool_or(F.col("name") == "saved_model.pb").alias("_saved_model"),
            F.bool_or(
                F.col("name").isin("config.json", "pytorch_model.bin", "model.safetensors")
            ).alias("_hub_model"),
            F.count(F.lit(1)).alias("files"),
        )
        .select(
            "directory",
            F.when(F.col("_saved_model"), "tensorflow_saved_model")
            .when(F.col("_hub_model"), "huggingface_model")
            .otherwise("directory")
            .alias("format"),
            "files",
        )
    )


def scanners_for(
    path: Column, suffix: Column, format_name: Column,
    include: list[str] | None = None, exclude: list[str] | None = None,
) -> Column:
    """Array of the detectors that take an artifact.

    The routing table is fixed, so it is a literal map from extension or format
    to detectors: a narrow lookup instead of a join on an OR condition.
    """
    takers: dict[str, list[str]] = {}
    for name, tokens in M.ROUTES.items():
        if (not include or name in include) and not (exclude and name in exclude):
            for token in tokens:
                takers.setdefault(token, []).append(name)
    if not takers:
        return F.array().cast("array<string>")
    cells = []
    for token, names in takers.items():
        cells += [F.lit(token), F.array(*[F.lit(n) for n in names])]
    table = F.create_map(*cells)
    keys = F.array(extension(path), suffix, format_name, F.concat(F.lit("."), format_name), F.lit("*"))
    return F.array_distinct(
        F.flatten(F.array_compact(F.transform(keys, lambda key: F.try_element_at(table, key))))
    )


def routes(
    resolved: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """(path, scanner) for every detector that should see an artifact."""
    takers = scanners_for(F.col("path"), F.col("extension"), F.col("format"), include, exclude)
    return resolved.select("path", F.explode(takers).alias("scanner"))


def scanners_executed(routed: DataFrame) -> DataFrame:
    """Detectors executed, with the number of artifacts each has seen."""
    return routed.groupBy("scanner").agg(F.count(F.lit(1)).alias("artifacts"))


def is_binary(content: Column) -> Column:
    """A NUL byte, or over 30 % control bytes, in the first 8 KB."""
    sample = B.latin1(F.substring(content, 1, 8192))
    # Bytes that count as text are 7-10, 12, 13, 27 and 32-255 without 127.
    odd = F.regexp_count(sample, F.lit(r"[\x00-\x06\x0b\x0e-\x1a\x1c-\x1f\x7f]"))
    return F.contains(sample, F.lit("\x00")) | (odd > F.length(sample) * 0.30)


def pattern_offsets(artifacts: DataFrame, patterns: list[bytes]) -> DataFrame:
    """Every offset of every byte pattern, overlapping matches included."""
    text = B.latin1(F.col("content"))
    found = []
    for raw in patterns:
        look = "".join(f"\\x{byte:02x}" for byte in raw)
        pieces = F.split(F.col("_text"), f"(?={look})")
        found.append(
            artifacts.select("path", text.alias("_text"))
            .where(F.contains(F.col("_text"), B.literal_text(raw)))
            .select("path", F.explode(_starts(pieces, raw)).alias("offset"))
            .select("path", F.lit(raw.hex()).alias("pattern"), "offset")
        )
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _starts(pieces: Column, raw: bytes) -> Column:
    """Offsets at which the pieces that begin with the pattern start."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("hits"))
    return F.aggregate(
        pieces,
        state,
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece)).alias("at"),
            F.when(
                F.startswith(piece, B.literal_text(raw)), F.concat(acc["hits"], F.array(acc["at"]))
            )
            .otherwise(acc["hits"])
            .alias("hits"),
        ),
        lambda acc: acc["hits"],
    )


def digests(artifacts: DataFrame) -> DataFrame:
    """Full digests, and a quick id over the size and the first MiB."""
    content = F.col("content")
    size = F.encode(F.octet_length(content).cast("string"), "UTF-8")
    return artifacts.select(
        "path",
        F.sha2(content, 256).alias("sha256"),
        F.sha1(content).alias("sha1"),
        F.md5(content).alias("md5"),
        F.substring(F.md5(F.concat(size, F.substring(content, 1, 1024 * 1024))), 1, 16).alias("quick_id"),
    )
