"""Scanning only what is new or has changed, with progress that survives a restart."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tamperlens.schema import ARTIFACTS
from tamperlens.sources.paged import PAGE, opened

Detector = Callable[[DataFrame], DataFrame]

# A version of an artifact: its digest may be null, then it is taken from the file where time or length differ.
VERSIONS = "path string, modified long, length long, sha256 string"
# What was last seen of the paths of a group.
_KNOWN = "path array<string>, modified array<long>, length array<long>, sha256 array<string>"
# Groups of paths that keep a state: a group costs far more than a path. A stream keeps the number it began with.
GROUPS = 4096

_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    """Folder for the progress of a stream, inside the one the cluster shares; one of our own only in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tamperlens-"))
    return f"{shared.rstrip('/')}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read to the shared folder, and read it back."""
    path = f"{checkpoint_dir(df.sparkSession, 'kept')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of them."""
    # A stream does not take a file for its path, but it takes a pattern that only the file or folder matches.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stamp() -> str:
    """A name for the folders of one run."""
    return str(time.time_ns())


def artifact_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """New files under a path, as they appear."""
    return (
        spark.readStream.format("binaryFile")
        .schema(ARTIFACTS)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .load(path)
    )


def scan_stream(
    stream: DataFrame, detect: Detector, output: str, checkpoint: str
) -> StreamingQuery:
    """Write the findings of every new artifact to Parquet, then stop.

    Files and findings are recorded together: after a failure the run goes on
    from the last complete batch and writes nothing twice. ``detect`` must be
    narrow (rule packs, byte rules), as any stateless streaming query.
    """
    return (
        detect(stream)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def digested(artifacts: DataFrame, modified: int) -> DataFrame:
    """Versions of artifacts whose ``content`` is at hand."""
    return artifacts.select(
        "path", F.lit(modified).cast("long").alias("modified"), F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256")
    )


def announce(spark: SparkSession, path: str, inbox: str) -> None:
    """List a folder into ``inbox`` as one more drop of versions, without reading a file.

    A stream over the folder itself never sees a path again; one over the inbox
    does, with its new time and length.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", F.unix_micros("modificationTime").alias("modified"), "length", F.lit(None).cast("string").alias("sha256"))
    listed.write.mode("append").parquet(inbox)


def versions(spark: SparkSession, inbox: str, files_per_batch: int = 1000) -> DataFrame:
    """The drops of an inbox as a stream."""
    return spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", str(files_per_batch)).parquet(inbox)


def _digest(path: str) -> str | None:
    """Digest of a whole file, page by page; None when it cannot be read."""
    try:
        file, total, at = opened(path), hashlib.sha256(), 0
        while part := file[at : at + PAGE]:
            total.update(part)
            at += len(part)
        return total.hexdigest()
    except Exception:  # a file may be gone since it was listed
        return None


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest versions of a group's paths whose digest is not the one in the state, which then holds them."""
    newest: dict[str, tuple[int, int, str]] = {}
    for frame in frames:
        shas = (sha if isinstance(sha, str) else "" for sha in frame["sha256"])
        for path, *version in zip(frame["path"], frame["modified"].tolist(), frame["length"].tolist(), shas):
            newest[path] = max(newest.get(path, tuple(version)), tuple(version))
    known = {path: version for path, *version in zip(*state.get)} if state.exists else {}
    out, renewed = [], False
    for path, (modified, length, sha) in newest.items():
        before = known.get(path)
        if not sha and before is not None and before[:2] == [modified, length]:
            continue
        sha = sha or _digest(path)
        if sha is None:
            continue
        if before != [modified, length, sha]:
            known[path], renewed = [modified, length, sha], True
        if before is None or before[2] != sha:
            out.append((path, modified, length, sha))
    if renewed:
        state.update(([*known], *map(list, zip(*known.values()))))
    if out:
        yield pd.DataFrame(out, columns=["path", "modified", "length", "sha256"])


def changed(stream: DataFrame) -> DataFrame:
    """Versions whose content is not what was last seen under their path.

    The last time, length and whole digest of a path are kept on the executors,
    in the state of the group that the hash of the path names; a group is read
    and written as a whole, contents are neither shuffled nor kept. Several
    versions in a batch count as the newest. A file that cannot be read leaves its
    state as it is. Rows without path, time or length are passed over.
    """
    rows = stream.select("path", "modified", "length", "sha256").where("path is not null and modified is not null and length is not null")
    grouped = rows.withColumn("paths", F.pmod(F.xxhash64("path"), F.lit(GROUPS))).groupBy("paths")
    return grouped.applyInPandasWithState(_newest, VERSIONS, _KNOWN, "append", GroupStateTimeout.NoTimeout)


def scan_changed_stream(stream: DataFrame, detect: Detector, output: str, checkpoint: str) -> StreamingQuery:
    """Scan each new or changed artifact of a stream of versions once, then stop.

    ``detect`` takes the changed versions and reads the files itself, in chunks
    or pages (as ``scan_files`` does); it may group and join. Every batch goes to a
    folder of its own and the state is committed with the batch, so a batch that
    is tried again sees the earlier state and replaces what it wrote before.
    """

    def batch(rows: DataFrame, number: int) -> None:
        detect(rows).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        changed(stream).writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def with_quick_id(artifacts: DataFrame) -> DataFrame:
    """Add the short name of a content that reports show: over its size and first MiB, never used to tell changes."""
    size = F.encode(F.octet_length("content").cast("string"), "UTF-8")
    quick = F.substring(F.md5(F.concat(size, F.substring("content", 1, 1024 * 1024))), 1, 16)
    return artifacts.withColumn("quick_id", quick)
