"""The tables that detectors read and write."""

from __future__ import annotations

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SEVERITY = _schema(
    ("level", T.StringType()),
    ("cvss_score", T.DoubleType()),
    ("cvss_vector", T.StringType()),
)
TEXT_MAP = T.MapType(T.StringType(), T.StringType())

FINDINGS = _schema(
    ("path", T.StringType()),
    ("source", T.StringType()),
    ("scanner", T.StringType()),
    ("vulnerability_type", T.StringType()),
    ("severity", SEVERITY),
    ("description", T.StringType()),
    ("location", TEXT_MAP),
    ("evidence", TEXT_MAP),
    ("recommendation", T.StringType()),
    ("references", T.ArrayType(T.StringType())),
    ("cwe_id", T.StringType()),
    ("cve_id", T.StringType()),
    ("finding_id", T.StringType()),
)

ISSUES = _schema(
    ("path", T.StringType()),
    ("scanner", T.StringType()),
    ("kind", T.StringType()),
    ("message", T.StringType()),
)

ARTIFACTS = _schema(
    ("path", T.StringType()),
    ("modificationTime", T.TimestampType()),
    ("length", T.LongType()),
    ("content", T.BinaryType()),
)

MEMBERS = _schema(
    ("path", T.StringType()),
    ("ordinal", T.IntegerType()),
    ("entry", T.StringType()),
    ("origin", T.StringType()),
    ("unix_mode", T.IntegerType()),
    ("is_link", T.BooleanType()),
    ("link_target", T.StringType()),
)

MEMBER_CONTENTS = _schema(
    ("path", T.StringType()),
    ("entry", T.StringType()),
    ("content", T.BinaryType()),
    ("error", T.StringType()),
)

CHUNKS = _schema(
    ("path", T.StringType()),
    ("chunk_no", T.IntegerType()),
    ("offset", T.LongType()),
    ("bytes", T.BinaryType()),
    ("halo", T.BinaryType()),
)

OPCODES = _schema(
    ("source", T.StringType()),
    ("seq", T.LongType()),
    ("pos", T.LongType()),
    ("opcode", T.StringType()),
    ("arg", T.StringType()),
)

IMPORTS = _schema(
    ("source", T.StringType()),
    ("seq", T.LongType()),
    ("module", T.StringType()),
    ("name", T.StringType()),
)

GGUF_KV = _schema(
    ("path", T.StringType()),
    ("idx", T.IntegerType()),
    ("offset", T.LongType()),
    ("key_len", U64),
    ("key", T.StringType()),
    ("value_type", T.LongType()),
    ("value_offset", T.LongType()),
    ("str_len", U64),
    ("arr_type", T.LongType()),
    ("arr_len", U64),
    ("truncated", T.BooleanType()),
)

GGUF_TENSORS = _schema(
    ("path", T.StringType()),
    ("idx", T.IntegerType()),
    ("offset", T.LongType()),
    ("name_len", U64),
    ("n_dims", T.LongType()),
    ("dims", T.ArrayType(U64)),
)

WEIGHT_SLICES = _schema(
    ("path", T.StringType()),
    ("layer", T.StringType()),
    ("first_pos", T.LongType()),
    ("values", T.ArrayType(T.FloatType())),
)

SAFETENSORS_HEADERS = _schema(
    ("path", T.StringType()),
    ("header_size", U64),
    ("text", T.StringType()),
)
