"""Large files in pieces, each read by its own task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamperlens.schema import CHUNKS
from tamperlens.sources.frames import frames

# Bytes of a chunk, and of the overlap behind it.
CHUNK, HALO = 8 * 1024 * 1024, 1024


# Schemes by which Spark names stores that Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


def arrow_uri(path: str) -> str:
    """A path as Spark gives it, which encodes nothing, as a URI for Arrow: its scheme, and blanks and the like encoded."""
    from urllib.parse import quote

    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return "file://" + quote(path)
    rest = "//" + rest if rest.startswith("/") and not rest.startswith("//") else rest
    return f"{SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/:@')}"


def _open(path: str):
    """A random-access reader on any filesystem Arrow knows."""
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(arrow_uri(path))
    return filesystem.open_input_file(inner)


def plan(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, length, chunk_no, offset, and what else ``files`` has) of every chunk; the file content is not read."""
    last = F.greatest(F.ceil(F.col("length") / F.lit(chunk)) - 1, F.lit(0)).cast("int")
    return files.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")).withColumn(
        "offset", F.col("chunk_no").cast("bigint") * chunk
    )


def read(plan: DataFrame, chunk: int = CHUNK, halo: int = HALO, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with their bytes, and the columns of the plan named by ``carry``; the chunks of one file are spread over the tasks."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(batch[c] for c in ("path", "chunk_no", "offset", *carry))):
                with _open(row[0]) as handle:
                    handle.seek(int(row[2]))
                    data = handle.read(chunk + halo)
                yield *row[:3], data[:chunk], data[chunk:], *row[3:]

    schema = StructType([*CHUNKS, *(plan.schema[c] for c in carry)])

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(pieces(batches), schema.names, heavy=3)

    spread = plan.select("path", "chunk_no", "offset", *carry).repartition("path", "chunk_no")
    return spread.mapInPandas(job, schema)


def chunks(spark: SparkSession, path: str, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read(plan(files.select("path", "length"), chunk), chunk, halo)


def in_memory(artifacts: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """The same rows cut from content that is already a column."""
    at = F.col("offset").cast("int")
    sized = artifacts.select("path", F.octet_length("content").cast("bigint").alias("length"), "content")
    last = F.greatest(F.ceil(F.col("length") / F.lit(chunk)) - 1, F.lit(0)).cast("int")
    return (
        sized.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("offset", F.col("chunk_no").cast("bigint") * chunk)
        .select(
            "path", "chunk_no", "offset",
            F.substr("content", at + 1, F.lit(chunk)).alias("bytes"),
            F.substr("content", at + 1 + chunk, F.lit(halo)).alias("halo"),
        )
    )


def coverage(chunks: DataFrame) -> DataFrame:
    """(path, chunks, bytes_scanned) per file; the overlap is not counted twice."""
    return chunks.groupBy("path").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("bytes").cast("bigint")).alias("bytes_scanned")
    )


def aligned(chunk: int, halo: int) -> Column:
    """Byte view of a chunk from the first break at or behind its beginning to that of the next one.

    Aligned texts of a file are its bytes, each once: what they count adds up, and
    no line is cut unless it is longer than the overlap. Both sides of a border
    look for the break in the same bytes.
    """
    reach = min(chunk, halo)

    def lead(view: Column) -> Column:
        seen = F.substring(view, 1, reach)
        at = F.length(F.regexp_extract(seen, "^[^\\x00\\n]*", 0))
        return F.when(at < F.length(seen), at).otherwise(0)

    own, rest = (F.decode(c, "ISO-8859-1") for c in ("bytes", "halo"))
    start = F.when(F.col("offset") > 0, lead(F.concat(own, rest))).otherwise(0)
    return F.substr(F.concat(own, rest), start + 1, F.greatest(F.length(own) - start + lead(rest), F.lit(0)))
