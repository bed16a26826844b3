"""Jobs that turn binary files into rows: opcodes, directories, tensors.

Each function yields rows as it reads. A damaged file ends its own rows and
fails nothing else. Pickles are disassembled, never loaded.
"""

from __future__ import annotations

import pickletools
import struct
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamperlens.operators.pickles import MEMO_GET, MEMO_PUT, STRING_PUSH
from tamperlens.rules import markers as M
from tamperlens.schema import GGUF_KV, GGUF_TENSORS, IMPORTS, OPCODES, WEIGHT_SLICES
from tamperlens.sources.chunks import _open
from tamperlens.sources.frames import frames
from tamperlens.sources.paged import Pages, per_file, stream

# Dimensions of a tensor that are listed; more than a few are a violation.
DIMS = 1024

def pickle_streams(artifacts: DataFrame, member_contents: DataFrame) -> DataFrame:
    """(source, content): pickle files, and the pickles inside PyTorch zips.

    A ``.pth`` or ``.pt`` that is no zip is read as a plain pickle.
    """
    zipped = F.startswith("content", F.unhex(F.lit("504b0304")))
    lone = artifacts.where(~zipped).select(F.col("path").alias("source"), "content")
    return lone.unionByName(inner_streams(member_contents))


def inner_streams(member_contents: DataFrame) -> DataFrame:
    """(source, content) of the pickles among archive members."""
    return member_contents.where(F.endswith("entry", F.lit(".pkl")) & F.col("content").isNotNull()).select(
        F.concat_ws(":", "path", "entry").alias("source"), "content"
    )


def _ops_of(source: str, content: bytes | Pages) -> Iterator[tuple]:
    """Opcodes of all pickles in the content, one after another; a later one begins behind STOP."""
    file, seq = stream(content), 0
    try:
        while file.tell() < len(content):
            for op, arg, pos in pickletools.genops(file):
                yield source, seq, pos, op.name, None if arg is None else str(arg)
                seq += 1
    except Exception:  # a broken stream keeps the opcodes before the break
        return


def opcodes(streams: DataFrame) -> DataFrame:
    """Opcode rows of every stream."""

    return per_file(_by_source(streams), _ops_of, OPCODES)


def _by_source(streams: DataFrame) -> DataFrame:
    """Streams under the name of their source; without a ``content`` column the source is a path to read."""
    return streams.select(F.col("source").alias("path"), *(c for c in ("content",) if c in streams.columns))


def _imports_of(source: str, content: bytes | Pages) -> Iterator[tuple]:
    """Imports named by a pickle, read in one pass without building anything.

    Only strings are followed: the last two pushed, and those put in the memo.
    """
    memo: dict[str, str | None] = {}
    stored = 0
    last: list[str] = []
    pushed: str | None = None
    for _, seq, _, op, arg in _ops_of(source, content):
        now = None
        if op == "GLOBAL" and arg and " " in arg:
            yield (source, seq, *arg.split(" ", 1))
        elif op == "STACK_GLOBAL" and len(last) == 2:
            yield source, seq, last[0], last[1]
        elif op in STRING_PUSH:
            now = arg
        elif op == "MEMOIZE" or op in MEMO_PUT:
            memo[str(stored) if op == "MEMOIZE" else arg] = pushed
            stored += 1
        elif op in MEMO_GET:
            text = memo.get(arg)
            last = last if text is None else [*last, text][-2:]
        if now is not None:
            last = [*last, now][-2:]
        pushed = now


def pickle_imports(streams: DataFrame) -> DataFrame:
    """(source, seq, module, name) straight from the streams, without a shuffle.

    The same rows as ``imports(opcodes(streams))``, for when no opcode table is
    needed.
    """

    return per_file(_by_source(streams), _imports_of, IMPORTS)


class _Cursor:
    """A place in bytes or pages; what is skipped is not read."""

    def __init__(self, data: bytes | Pages, at: int):
        self.data, self.at = data, at

    def number(self, form: str) -> int | None:
        width = struct.calcsize(form)
        if self.at + width > len(self.data):
            self.at = len(self.data)
            return None
        (value,) = struct.unpack(form, self.data[self.at : self.at + width])
        self.at += width
        return value

    def skip(self, width: int) -> None:
        self.at = min(self.at + width, len(self.data))


def _skip_array(cursor: _Cursor, kind: int | None, count: int | None) -> None:
    """Skip the items of an array; arrays within it wait on a stack, however deep they lie."""
    waiting = [(kind, count)]
    while waiting and cursor.at < len(cursor.data):
        kind, count = waiting.pop()
        if not count or kind is None:
            continue
        if kind in M.GGUF_TYPE_SIZES:
            cursor.skip(M.GGUF_TYPE_SIZES[kind] * count)
        elif kind in (M.GGUF_STRING, M.GGUF_ARRAY):
            waiting.append((kind, count - 1))
            if kind == M.GGUF_STRING:
                cursor.skip(cursor.number("<Q") or 0)
            else:
                waiting.append((cursor.number("<I"), cursor.number("<Q")))


def _u64(value: int | None) -> Decimal | None:
    return None if value is None else Decimal(value)


def _kv_of(path: str, cursor: _Cursor, count: int) -> Iterator[tuple]:
    for idx in range(count):
        offset = cursor.at
        if offset >= len(cursor.data):
            return
        key_len = cursor.number("<Q")
        if key_len is None:
            yield path, idx, offset, None, None, None, None, None, None, None, True
            return
        # A longer key is a violation by its length alone.
        key = cursor.data[cursor.at : cursor.at + min(key_len, M.GGUF_MAX_STRING)].decode("utf-8", "replace")
        cursor.skip(key_len)
        kind = cursor.number("<I")
        value_at, text_len, item_kind, items = cursor.at, None, None, None
        if kind == M.GGUF_STRING:
            text_len = cursor.number("<Q")
            cursor.skip(text_len or 0)
        elif kind == M.GGUF_ARRAY:
            item_kind, items = cursor.number("<I"), cursor.number("<Q")
            _skip_array(cursor, item_kind, items)
        elif kind in M.GGUF_TYPE_SIZES:
            cursor.skip(M.GGUF_TYPE_SIZES[kind])
        yield (
            path, idx, offset, _u64(key_len), key, kind, value_at, _u64(text_len), item_kind, _u64(items), kind is None,
        )
        if kind is None or kind > M.GGUF_MAX_TYPE:
            return  # nothing behind an unknown type can be located


def _tensors_of(path: str, cursor: _Cursor, count: int) -> Iterator[tuple]:
    for idx in range(count):
        offset = cursor.at
        name_len = cursor.number("<Q")
        if name_len is None:
            return
        cursor.skip(name_len)
        n_dims = cursor.number("<I")
        dims = []
        for _ in range(min(n_dims or 0, DIMS)):
            dim = cursor.number("<Q")
            if dim is None:
                break
            dims.append(_u64(dim))
        yield path, idx, offset, _u64(name_len), n_dims, dims
        if n_dims is None:
            return
        # Dimensions that are not listed, type and data offset.
        cursor.skip(8 * max(0, n_dims - DIMS) + 12)


def _directory(content: bytes | Pages) -> tuple[_Cursor, int, int] | None:
    if len(content) < 24 or content[:4] != b"GGUF":
        return None
    n_tensors, n_kv = struct.unpack("<QQ", content[8:24])
    return _Cursor(content, 24), n_tensors, n_kv


def gguf_kv(artifacts: DataFrame) -> DataFrame:
    """Metadata directory rows of GGUF files, by content or by path; every entry, not the first thousand."""

    def entries(path: str, content: bytes) -> Iterator[tuple]:
        found = _directory(content)
        if found:
            cursor, _, n_kv = found
            yield from _kv_of(path, cursor, n_kv)

    kv = per_file(artifacts, entries, GGUF_KV)
    sensitive = F.exists(
        F.array(*[F.lit(k) for k in M.GGUF_SENSITIVE_KEYS]), lambda k: F.contains("key", k)
    )
    return kv.withColumn("sensitive", F.coalesce(sensitive, F.lit(False)))


def gguf_tensors(artifacts: DataFrame) -> DataFrame:
    """Tensor directory rows of GGUF files, by content or by path."""

    def entries(path: str, content: bytes) -> Iterator[tuple]:
        found = _directory(content)
        if found:
            cursor, n_tensors, n_kv = found
            passed, kind = 0, None
            for row in _kv_of(path, cursor, n_kv):
                passed, kind = passed + 1, row[5]
            # Behind a directory that could not be passed whole, no tensor can be located.
            if passed == n_kv and (not n_kv or (kind is not None and kind <= M.GGUF_MAX_TYPE)):
                yield from _tensors_of(path, cursor, n_tensors)

    return per_file(artifacts, entries, GGUF_TENSORS)


_TENSOR = "struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>"


def tensor_table(headers: DataFrame) -> DataFrame:
    """(path, layer, dtype, begin, end) from safetensors headers; offsets from the file start."""
    parsed = F.from_json("text", f"map<string,{_TENSOR}>")
    base = F.col("header_size").cast("bigint") + 8
    return (
        headers.select("path", base.alias("base"), F.explode(parsed).alias("layer", "info"))
        .where((F.col("layer") != "__metadata__") & (F.size("info.data_offsets") == 2))
        .select(
            "path",
            "layer",
            F.coalesce("info.dtype", F.lit("F32")).alias("dtype"),
            (F.col("base") + F.col("info.data_offsets")[0]).alias("begin"),
            (F.col("base") + F.col("info.data_offsets")[1]).alias("end"),
        )
    )


# Bytes per number.
_WIDTHS = {"F32": 4, "F16": 2, "BF16": 2}
# Numbers that leave in one batch.
HELD = 1 << 20


def tensor_slices(tensors: DataFrame, values: int = 1 << 20) -> DataFrame:
    """Tensors cut into slices of a bounded number of values: (.., first_pos, begin, size)."""
    width = F.when(F.col("dtype") == "F32", 4).when(F.col("dtype").isin("F16", "BF16"), 2)
    count = F.floor((F.col("end") - F.col("begin")) / F.col("width"))
    first = F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0)), F.lit(values).cast("bigint"))
    return (
        tensors.withColumn("width", width)
        .where(F.col("width").isNotNull() & (count > 0))
        .withColumn("first_pos", F.explode(first))
        .withColumn("size", F.least(F.lit(values), count - F.col("first_pos")) * F.col("width"))
        .withColumn("begin", F.col("begin") + F.col("first_pos") * F.col("width"))
        .select("path", "layer", "dtype", "first_pos", "begin", "size")
    )


def _decode(data: bytes, dtype: str) -> np.ndarray:
    data = data[: len(data) // _WIDTHS[dtype] * _WIDTHS[dtype]]
    if dtype == "F32":
        return np.frombuffer(data, "<f4")
    if dtype == "F16":
        return np.frombuffer(data, "<f2").astype("float32")
    return (np.frombuffer(data, "<u2").astype("uint32") << 16).view("float32")


def exploded(slices: DataFrame) -> DataFrame:
    """(path, layer, pos, value): one row per number, for small tables."""
    return slices.select("path", "layer", "first_pos", F.posexplode("values").alias("_i", "value")).select(
        "path", "layer", (F.col("first_pos") + F.col("_i")).alias("pos"), "value"
    )


def _valued(batches: Iterator[pa.RecordBatch], names: list[str], read, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Slices beside their values: small ones leave together, about ``most`` numbers at a time."""
    for batch in batches:
        told = [c for c in batch.schema.names if c in ("path", "dtype", "begin", "size", "data")]
        start, ends, held = 0, [0], []
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in told}
            held.append(_decode(read(row), row["dtype"]))
            ends.append(ends[-1] + len(held[-1]))
            if ends[-1] >= most or k + 1 == batch.num_rows:
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held), pa.float32()))
                some = batch.slice(start, k + 1 - start)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), listed], [*names, "values"])
                start, ends, held = k + 1, [0], []


def _with_values(slices: DataFrame, read) -> DataFrame:
    """Add ``values`` to every slice; ``read`` gives the bytes of a row."""
    names = [c for c in slices.columns if c != "data"]
    schema = StructType([*(slices.schema[c] for c in names), WEIGHT_SLICES["values"]])
    return slices.mapInArrow(lambda batches: _valued(batches, names, read), schema)


def read_slices(slices: DataFrame) -> DataFrame:
    """Slices with their values, read by range, beside their other columns; the slices of one tensor go to many tasks."""

    def read(row: dict) -> bytes:
        with _open(row["path"]) as handle:
            handle.seek(row["begin"])
            return handle.read(row["size"])

    return _with_values(slices.repartition("path", "layer", "first_pos"), read)


def decode_slices(slices: DataFrame) -> DataFrame:
    """Slices with their values out of their bytes, a column ``data``."""
    return _with_values(slices, lambda row: row["data"])


# Number formats of storage classes; whole numbers are indices and counters, no weights.
_STORAGES = {"FloatStorage": "F32", "HalfStorage": "F16", "BFloat16Storage": "BF16"}


def _storages_of(path: str, entry: str, content: bytes) -> Iterator[tuple]:
    """(path, member, class) of the storages that a model's pickle names, read off its persistent ids; nothing is built.

    A persistent id is a tuple of the word ``storage``, a class, a key, a place and
    a size. Only strings and classes are followed, through the memo as well.
    """
    memo: dict[str, tuple | None] = {}
    stored, last = 0, []
    for _, _, _, op, arg in _ops_of(path, content):
        if op == "MEMOIZE" or op in MEMO_PUT:
            memo[str(stored) if op == "MEMOIZE" else arg] = last[-1] if last else None
            stored += 1
            continue
        if op == "GLOBAL" and arg and " " in arg:
            last.append(("class", arg.split(" ", 1)[1]))
        elif op == "STACK_GLOBAL" and len(last) > 1 and last[-1] is not None:
            last[-2:] = [("class", last[-1][1])]
        elif op in STRING_PUSH:
            last.append(("text", arg))
        elif op in MEMO_GET:
            last.append(memo.get(arg))
        elif op == "BINPERSID":
            for k in range(len(last) - 3, -1, -1):
                if last[k] == ("text", "storage") and last[k + 1] and last[k + 1][0] == "class" and last[k + 2] and last[k + 2][0] == "text":
                    yield path, f"{entry.rpartition('/')[0]}/data/{last[k + 2][1]}".lstrip("/"), last[k + 1][1]
                    break
            last = []
        elif op != "BININT" and op != "BININT1" and op != "BININT2" and op != "MARK" and not op.startswith("TUPLE"):
            last.append(None)
        last = last[-12:]


def storage_classes(member_contents: DataFrame) -> DataFrame:
    """(path, entry, storage): the class of each stored tensor of PyTorch archives."""
    schema = "path string, entry string, storage string"

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for found in zip(batch["path"], batch["entry"], batch["content"]) for row in _storages_of(*found))
        return frames(rows, ["path", "entry", "storage"])

    named = member_contents.where(F.endswith("entry", F.lit("data.pkl")) & F.col("content").isNotNull())
    return named.select("path", "entry", "content").mapInPandas(job, schema).distinct()


def pytorch_slices(member_contents: DataFrame, values: int = 1 << 16) -> DataFrame:
    """Slices of storage members, whole, in the number format that the model's pickle names (32-bit floats if it names none)."""
    known = F.create_map(*[F.lit(x) for pair in _STORAGES.items() for x in pair])
    kinds = storage_classes(member_contents).select("path", F.col("entry").alias("_entry"), "storage").groupBy("path", "_entry").agg(F.min("storage").alias("storage"))
    named = F.contains("entry", F.lit("data")) | F.endswith("entry", F.lit(".npy"))
    stored = member_contents.where(named & F.col("content").isNotNull()).select("path", "entry", "content")
    typed = stored.join(kinds.withColumnRenamed("path", "_path"), (F.col("path") == F.col("_path")) & (F.col("entry") == F.col("_entry")), "left")
    dtype = F.when(F.col("storage").isNull(), "F32").otherwise(F.try_element_at(known, F.col("storage")))
    width = F.when(F.col("dtype") == "F32", 4).otherwise(2)
    cut = (
        typed.select("path", F.col("entry").alias("layer"), dtype.alias("dtype"), "content")
        .where(F.col("dtype").isNotNull())
        .withColumn("_n", F.floor(F.octet_length("content") / width))
        .where("_n > 0")
        .withColumn("first_pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(values).cast("bigint"))))
        .select("path", "layer", "dtype", "first_pos", F.substr("content", (F.col("first_pos") * width + 1).cast("int"), (width * values).cast("int")).alias("data"))
    )
    return decode_slices(cut)
