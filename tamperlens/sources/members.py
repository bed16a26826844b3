"""Members of zip and tar archives, in bulk.

Zip listings are column expressions over the bytes, of whole files or of chunks.
Tar headers, each of which says where the next one is, and compressed content
are read in Python, page by page; nothing is written to disk.
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.operators.formats import archive_kind, magic_format
from tamperlens.schema import MEMBER_CONTENTS, MEMBERS
from tamperlens.sources.paged import Pages, per_file, stream

# Bytes of an unpacked member that are held at once.
MEMBER = 256 * 1024 * 1024

# Record signatures, and offsets of fields behind the signature.
_CENTRAL, _LOCAL = r"PK\x01\x02", r"PK\x03\x04"


def _name(piece: Column, start: int, length: Column) -> Column:
    raw = F.substr(piece, F.lit(start + 1), length)
    return B.utf8(F.encode(raw, "ISO-8859-1"))


def _pieces(columns: list[str], signature: str) -> Column:
    """What follows each signature. A chunk has those that begin in its own bytes, and reads on behind its end."""
    if "halo" not in columns:
        return F.split(B.latin1(F.col("content")), signature)
    own = F.split(B.latin1(F.concat("bytes", F.substring("halo", 1, 3))), signature)
    rest = B.latin1(F.substring("halo", 4, 2**30))
    return F.concat(F.slice(own, F.lit(1), F.size(own) - 1), F.array(F.concat(F.element_at(own, -1), rest)))


def _records(artifacts: DataFrame, signature: str, fixed: int) -> DataFrame:
    pieces = _pieces(artifacts.columns, signature)
    return (
        artifacts.select("path", F.posexplode(pieces).alias("ordinal", "piece"))
        # What precedes the first signature is no record; nor is a piece too short for one.
        .where((F.col("ordinal") > 0) & (F.length("piece") >= fixed))
        .withColumn("ordinal", F.col("ordinal") - 1)
    )


def zip_members(artifacts: DataFrame) -> DataFrame:
    """Central and local records of zip files.

    A signature may also occur inside stored data; a record counts only when
    its fixed fields make sense. Rows may be whole files (``content``) or chunks
    (``bytes`` and ``halo``), whose records are numbered per chunk.
    """
    piece = F.col("piece")
    central = (
        _records(artifacts, _CENTRAL, 42)
        .withColumn("name_len", B.char_u16(piece, 24))
        .withColumn("attributes", B.char_u32(piece, 34))
        .where((F.col("name_len") > 0) & (F.length(piece) >= 42 + F.col("name_len")) & (B.char_u16(piece, 2) <= 100))
        .select(
            "path",
            "ordinal",
            _name(piece, 42, F.col("name_len")).alias("entry"),
            F.lit("central").alias("origin"),
            F.shiftrightunsigned("attributes", 16).cast("int").alias("unix_mode"),
        )
    )
    # Compression methods in use.
    methods = [0, 8, 9, 12, 14, 93, 95, 98, 99]
    local = (
        _records(artifacts, _LOCAL, 26)
        .withColumn("name_len", B.char_u16(piece, 22))
        .where(
            (F.col("name_len") > 0)
            & (F.length(piece) >= 26 + F.col("name_len"))
            & (B.char_u16(piece, 0) <= 100)
            & B.char_u16(piece, 4).isin(methods)
        )
        .select(
            "path",
            "ordinal",
            _name(piece, 26, F.col("name_len")).alias("entry"),
            F.lit("local").alias("origin"),
            F.lit(None).cast("int").alias("unix_mode"),
        )
    )
    is_link = F.coalesce(F.col("unix_mode").bitwiseAND(0o170000) == 0o120000, F.lit(False))
    return central.unionByName(local).select(
        "path", "ordinal", "entry", "origin", "unix_mode",
        is_link.alias("is_link"), F.lit(None).cast("string").alias("link_target"),
    )


def _tar_entries(path: str, data: bytes | Pages) -> Iterator[tuple]:
    """Headers one after another, the data between them skipped; long-name records belong to the header behind them."""
    with tarfile.open(fileobj=stream(data), mode="r:*") as tar:
        for i, m in enumerate(tar):
            link = m.issym() or m.islnk()
            yield path, i, m.name, "tar", m.mode, link, m.linkname if link else None
            tar.members.clear()  # else the listing of a large archive is held


def tar_members(artifacts: DataFrame) -> DataFrame:
    """Headers of tar files, packed or not, up to a break; ``member_contents`` names the problem."""
    return per_file(artifacts, _tar_entries, MEMBERS)


def members(artifacts: DataFrame) -> DataFrame:
    """Members of every archive, chosen by how the archive has to be read."""
    kind = archive_kind(F.col("path"), magic_format(F.col("content")))
    sorted_out = artifacts.select("path", "content", kind.alias("kind")).where(F.col("kind").isNotNull())
    zips = zip_members(sorted_out.where(F.col("kind") == "zip"))
    return zips.unionByName(tar_members(sorted_out.where(F.col("kind") != "zip")))


def _read(path: str, entry: str, file) -> tuple:
    """One member, at most ``MEMBER`` bytes of it held; a larger one is named as an issue."""
    data = file.read(MEMBER + 1)
    if len(data) > MEMBER:
        return path, entry, None, f"member of over {MEMBER} bytes was not unpacked"
    return path, entry, data, None


def _zip_contents(path: str, data: bytes | Pages) -> Iterator[tuple]:
    with zipfile.ZipFile(stream(data)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                try:
                    with archive.open(info) as file:
                        yield _read(path, info.filename, file)
                except Exception as problem:  # one bad member must not fail the job
                    yield path, info.filename, None, str(problem)


def _tar_contents(path: str, data: bytes | Pages) -> Iterator[tuple]:
    with tarfile.open(fileobj=stream(data), mode="r:*") as archive:
        for m in archive:
            if m.isfile():
                yield _read(path, m.name, archive.extractfile(m))
            archive.members.clear()


def _contents(kind: str):
    def entries(path: str, data: bytes | Pages) -> Iterator[tuple]:
        try:
            yield from (_zip_contents if kind == "zip" else _tar_contents)(path, data)
        except Exception as problem:  # hostile files raise far more than the libraries' own errors
            yield path, None, None, str(problem)

    return entries


def member_contents(artifacts: DataFrame) -> DataFrame:
    """(path, entry, content, error): unpacked members, one row at a time.

    Archives are read from ``content``, or from their path where there is a
    ``kind`` (zip or tar) instead.
    """
    if "kind" not in artifacts.columns:
        kind = archive_kind(F.col("path"), magic_format(F.col("content")))
        artifacts = artifacts.select("path", "content", kind.alias("kind"))
    zips, tars = artifacts.where(F.col("kind") == "zip"), artifacts.where(F.col("kind") != "zip")
    return per_file(zips, _contents("zip"), MEMBER_CONTENTS, heavy=2).unionByName(per_file(tars, _contents("tar"), MEMBER_CONTENTS, heavy=2))


def member_issues(contents: DataFrame, scanner: str = "zip_slip") -> DataFrame:
    return contents.where(F.col("error").isNotNull()).select(
        "path", F.lit(scanner).alias("scanner"), F.lit("error").alias("kind"),
        F.concat_ws(": ", "entry", "error").alias("message"),
    )
