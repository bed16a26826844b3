"""A whole scan: artifacts in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.functions.bytesx import utf8
from tamperlens.functions.findings import findings_of
from tamperlens.operators import (
    algebra,
    archives,
    deps,
    formats,
    gguf,
    graphs,
    keras,
    metadata,
    pickles,
    polyglot,
    refs,
    textscan,
    weights,
)
from tamperlens.plans import large
from tamperlens.rules import markers as M
from tamperlens.sources import binary, members
from tamperlens.sources.artifacts import artifacts as read_artifacts
from tamperlens.sources.chunks import CHUNK


def _routed(artifacts: DataFrame, include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    """Artifacts with ``scanners``, the detectors that take them; found without a shuffle."""
    resolved = formats.resolve(artifacts.select("path", "length", "content"))
    return resolved.withColumn("source", F.col("path")).withColumn(
        "scanners", formats.scanners_for(F.col("path"), F.col("extension"), F.col("format"), include, exclude)
    )


def narrow_findings(routed: DataFrame) -> DataFrame:
    """Everything that one file can show by itself, in one pass over its bytes.

    Each detector is an array of hits computed in the row, so the content is
    read once, nothing is shuffled, and only hits leave the stage.
    """
    content = F.col("content")
    views = routed.select(
        "path", "source", "length", "scanners", "content",
        (F.col("archive_kind") == "zip").alias("zipped"),
        B.latin1(content).alias("bytes"),
        B.latin1(F.substring(content, 1, metadata.HEADER_WINDOW)).alias("window"),
        B.latin1(F.substring(content, 1, polyglot.SEARCH_HEAD)).alias("head"),
        B.latin1(F.right(content, F.lit(polyglot.SEARCH_TAIL))).alias("tail"),
        polyglot.signature_formats(F.substring(content, 1, 32)).alias("formats"),
    ).withColumns(
        {
            "lowered": F.lower("bytes"),
            "found": refs.urls_in(F.col("bytes")),
            "internal": refs.internal_urls_in(F.col("bytes")),
        }
    )
    text, signed = F.col("bytes"), F.col("formats")
    on = lambda name, hits: F.when(F.array_contains("scanners", name), hits)
    is_gguf = B.starts_with(content, b"GGUF")
    header = gguf.header_columns(
        B.unsigned_le(content, 4, 4).cast("bigint"), B.unsigned_le(content, 8, 8), B.unsigned_le(content, 16, 8), F.col("length")
    )
    unzipped = ~F.coalesce(F.col("zipped"), F.lit(False)) & F.col("found").isNotNull()
    groups = [
        on("lambda_layer", textscan.rule_columns(text, F.col("lowered"))),
        on("secrets", textscan.secret_columns(text, F.col("lowered"))),
        on("graph_injection", graphs.graph_columns(text)),
        on("metadata", F.concat(metadata.long_segment_columns(F.col("window")), metadata.code_pattern_columns(F.col("window")))),
        on("gguf", F.concat(gguf.template_columns(text), gguf.traversal_columns(text), gguf.marker_columns(text))),
        on("gguf", F.when(is_gguf, header)),
        on(
            "polyglot",
            F.concat(
                polyglot.mismatch_columns(F.col("path"), content, signed),
                polyglot.multiple_columns(signed),
                polyglot.embedded_columns(F.col("head"), F.col("tail"), signed),
                polyglot.trailing_columns(text, signed),
            ),
        ),
        on("external_ref", F.when(unzipped, refs.reference_columns(F.col("found"), F.col("internal")))),
    ]
    return findings_of(views, F.flatten(F.array_compact(F.array(*groups))))


def _member_texts(contents: DataFrame, view) -> DataFrame:
    return contents.where(F.col("content").isNotNull()).select(
        "path", "entry", F.concat_ws(":", "path", "entry").alias("source"), view(F.col("content")).alias("text")
    )


def scan(
    artifacts: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    work: str | None = None,
) -> DataFrame:
    """Findings of every detector over the artifacts routed to it; each row holds a file.

    Rules that need only the bytes of a file share one pass. What has to be
    parsed (archives, opcodes, directories, weights) is parsed for the files
    routed there; with a ``work`` folder on shared storage it is written once and
    read back, so that a lost executor costs no second parse.
    """
    routed = _routed(artifacts, include, exclude)
    wanted = _wanted(include, exclude)
    streams = _taken(routed, wanted, "pickle")
    return algebra.union(
        [
            narrow_findings(routed),
            *_parsed(
                routed, wanted, _keeper(artifacts.sparkSession, work),
                listed=members.members, contents=members.member_contents,
                marks=lambda inside: pickles.text_marks(binary.pickle_streams(streams, inside).withColumnRenamed("source", "path")),
                plain=lambda files: files.select("path", F.lit(None).cast("string").alias("entry"), "content"),
            ),
        ]
    )


def scan_files(
    files: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    work: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """The same findings for files (path, length) of any size: they are read in chunks and pages, never whole.

    Signals and parsed tables are used more than once, so give a ``work`` folder
    for large inputs. The context quoted with a template may be shorter at the
    border of a chunk.
    """
    keep = _keeper(files.sparkSession, work)
    routed = keep(large.routed_files(files, include, exclude), "routed")
    wanted = _wanted(include, exclude)
    signals = keep(large.signals(large.chunks_of(routed, chunk)), "signals")
    by_path = routed.drop("content", "tail")
    kind = F.when(F.col("archive_kind") == "zip", "zip").otherwise("tar")

    def marks(inside: DataFrame) -> DataFrame:
        streams = binary.pickle_streams(routed.where(F.lit(False)), inside)
        return large.pickle_marks(signals).unionByName(pickles.text_marks(streams.withColumnRenamed("source", "path")))

    return algebra.union(
        [
            large.head_findings(routed),
            large.signal_findings(signals, routed.select("path", "length")),
            *_parsed(
                by_path, wanted, keep,
                listed=lambda some: large.listings(some, chunk),
                contents=lambda some: members.member_contents(some.where(F.col("archive_kind").isNotNull()).select("path", kind.alias("kind"))),
                marks=marks,
                plain=lambda some: large.whole_files(some.where(deps.file_parser(F.col("path"), F.lit(None).cast("string")).isNotNull())).select("path", "entry", "content"),
            ),
        ]
    )


def _wanted(include: list[str] | None, exclude: list[str] | None) -> list[str]:
    return [n for n in M.ROUTES if (not include or n in include) and not (exclude and n in exclude)]


def _taken(routed: DataFrame, wanted: list[str], *names: str) -> DataFrame:
    """Files that one of the named detectors takes."""
    some = [n for n in names if n in wanted]
    return routed.where(F.arrays_overlap("scanners", F.array(*[F.lit(n) for n in some]))) if some else routed.where(F.lit(False))


def _keeper(spark: SparkSession, work: str | None):
    def kept(df: DataFrame, name: str) -> DataFrame:
        if work is None:
            return df
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    return kept


def _parsed(routed: DataFrame, wanted: list[str], kept, listed, contents, marks, plain) -> list[DataFrame]:
    """Findings of what has to be parsed. Parsers read ``content``, or the path of files that have no such column."""
    spark = routed.sparkSession
    taken_by = lambda *names: _taken(routed, wanted, *names)
    suffix = formats.full_suffix(F.col("path"))
    found = []
    readers = ("pickle", "metadata", "lambda_layer", "dependency", "backdoor", "external_ref")
    inner = kept(contents(taken_by(*readers)), "member_contents")
    if "zip_slip" in wanted or "polyglot" in wanted or "lambda_layer" in wanted:
        members_of = kept(listed(taken_by("zip_slip", "polyglot", "lambda_layer")), "members")
        if "zip_slip" in wanted:
            found.append(archives.archive_findings(members_of))
        if "polyglot" in wanted:
            found.append(polyglot.pytorch_findings(members_of))
        if "lambda_layer" in wanted:
            found.append(keras.zip_traversal(members_of.where(suffix == ".keras")))
    if "pickle" in wanted:
        inside = inner.where(suffix.isin(".pth", ".pt", ".bin"))
        opcodes, imports = (kept(f, name) for f, name in zip(_pickled(taken_by("pickle"), inside), ("opcodes", "imports")))
        found.append(pickles.verdicts(opcodes, marks(inside), imports))
    if "metadata" in wanted:
        files = taken_by("metadata").where(suffix == ".safetensors")
        json_texts = _member_texts(inner.where((suffix == ".keras") & F.endswith("entry", F.lit(".json"))), utf8)
        found += [metadata.safetensors_findings(files), metadata.field_findings(metadata.json_fields(json_texts))]
    if "lambda_layer" in wanted:
        configs = keras.config_texts(inner.where(suffix == ".keras"))
        found.append(keras.config_findings(configs))
    if "dependency" in wanted:
        inside = inner.where(suffix.isin(".whl", ".zip", ".tar.gz")).select("path", "entry", "content")
        declared = dependencies(plain(routed).unionByName(inside))
        found.append(deps.dependency_findings(declared, deps.popular_packages(spark)))
    if "gguf" in wanted:
        files = taken_by("gguf")
        tensors = kept(binary.gguf_tensors(files), "gguf_tensors")
        found += [
            gguf.kv_checks(binary.gguf_kv(files)),
            gguf.tensor_checks(tensors),
            gguf.cumulative(gguf.tensor_sizes(tensors)),
        ]
    if "backdoor" in wanted:
        files = taken_by("backdoor").where(suffix == ".safetensors")
        headers = metadata.safetensors_headers(files).where(F.col("text").isNotNull())
        tensors = binary.tensor_slices(binary.tensor_table(headers))
        # Slices of plain files are described and read where they are needed; those of archives are unpacked already.
        read = weights.anomalies(tensors, load=binary.read_slices, keep=lambda df, name: kept(df, f"tensors_{name}"))
        unpacked = kept(binary.pytorch_slices(inner.where(suffix.isin(".pth", ".pt"))), "storages")
        inside = weights.anomalies(unpacked, keep=lambda df, name: kept(df, f"storages_{name}"))
        found.append(weights.verdicts(read.unionByName(inside)))
    if "external_ref" in wanted:
        found.append(refs.reference_findings(_member_texts(inner, B.latin1)))
    return found


def _pickled(files: DataFrame, inside: DataFrame) -> list[DataFrame]:
    """Opcodes and imports of pickle files and of the pickles in archives."""
    if "content" in files.columns:
        streams = binary.pickle_streams(files, inside)
        return [binary.opcodes(streams), binary.pickle_imports(streams)]
    lone = files.where(F.col("archive_kind").isNull() | (F.col("archive_kind") != "zip")).select(F.col("path").alias("source"))
    packed = binary.inner_streams(inside)
    return [read(lone).unionByName(read(packed)) for read in (binary.opcodes, binary.pickle_imports)]


def scan_path(spark: SparkSession, path: str, work: str | None = None, **options) -> DataFrame:
    """Scan a file or folder. A file that fits a chunk is one row; any other is read in chunks and pages, with equal findings."""
    files = read_artifacts(spark, path)
    folder = lambda name: None if work is None else f"{work}/{name}"
    # The size filters reach the reader: large contents are never loaded as one value.
    small = scan(files.where(F.col("length") <= CHUNK), work=folder("whole"), **options)
    paged = scan_files(files.where(F.col("length") > CHUNK).select("path"), work=folder("paged"), **options)
    return small.unionByName(paged)


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies declared in requirement files: plain ones (no ``entry``) and members of wheels and archives."""
    texts = files.withColumn("parser", deps.file_parser(F.col("path"), F.col("entry"))).where(
        F.col("parser").isNotNull() & F.col("content").isNotNull()
    ).select("path", F.col("path").alias("source"), "parser", utf8(F.col("content")).alias("text"))
    parsers = {"requirements": deps.requirements, "pyproject": deps.pyproject, "setup_py": deps.setup_py, "wheel": deps.wheel}
    return algebra.union([parse(texts.where(F.col("parser") == name)) for name, parse in parsers.items()])


def issues(artifacts: DataFrame) -> DataFrame:
    """What could not be read, and why; no bad file fails a scan."""
    resolved = formats.resolve(artifacts.select("path", "length", "content"))
    named = formats.full_suffix(F.col("path")).isin(".gguf", ".ggml")
    contents = members.member_contents(artifacts)
    configs = keras.config_texts(contents)
    return (
        formats.unresolved(resolved)
        .unionByName(gguf.header_issues(artifacts.where(named)))
        .unionByName(members.member_issues(contents))
        .unionByName(keras.jsonwalk.parse_issues(configs, "lambda_layer"))
        .unionByName(graphs.saved_model_issues(graphs.saved_models(artifacts.select("path"))))
    )
