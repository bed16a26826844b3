"""Files made to break readers: each costs its own rows at most."""

from __future__ import annotations

import io
import pickle
import struct
import zipfile
from pathlib import Path

import pytest

from tamperlens.operators import deps
from tamperlens.plans.scan import dependencies
from tamperlens.sources import binary, chunks, members


def _gguf(kv: bytes, n_kv: int, tensors: bytes = b"", n_tensors: int = 0) -> bytes:
    return b"GGUF" + struct.pack("<IQQ", 3, n_tensors, n_kv) + kv + tensors


def _key(name: bytes) -> bytes:
    return struct.pack("<Q", len(name)) + name


def test_deep_arrays(spark):
    nested = _key(b"deep") + struct.pack("<I", 9) + struct.pack("<IQ", 9, 1) * 5000 + struct.pack("<IQI", 4, 1, 7)
    content = _gguf(nested + _key(b"next") + struct.pack("<II", 4, 1), 2)
    files = spark.createDataFrame([("a.gguf", content), ("b.gguf", _gguf(_key(b"k") + struct.pack("<II", 4, 1), 1))], "path string, content binary")
    assert {(r.path, r.key) for r in binary.gguf_kv(files).collect()} == {("a.gguf", "deep"), ("a.gguf", "next"), ("b.gguf", "k")}


def test_no_tensors_behind_an_unknown_type(spark):
    tensor = _key(b"w") + struct.pack("<IQIQ", 1, 4, 0, 0)
    good = _gguf(_key(b"k") + struct.pack("<II", 4, 1), 1, tensor, 1)
    bad = _gguf(_key(b"k") + struct.pack("<I", 99), 1, b"\xff" * 64, 1)
    files = spark.createDataFrame([("good", good), ("bad", bad), ("none", _gguf(b"", 0, tensor, 1))], "path string, content binary")
    assert sorted(r.path for r in binary.gguf_tensors(files).collect()) == ["good", "none"]


def test_pickles_behind_the_first(spark):
    content = pickle.dumps([1]) + b"cos\nsystem\n." + b"\x00 no pickle"
    streams = spark.createDataFrame([("s", content)], "source string, content binary")
    assert [(r.module, r.name) for r in binary.pickle_imports(streams).collect()] == [("os", "system")]
    assert binary.opcodes(streams).where("opcode = 'STOP'").count() == 2


def test_zip_of_a_later_version(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("a.txt", b"x")
    data = bytearray(packed.getvalue())
    at = data.index(b"PK\x01\x02")
    data[at + 6 : at + 8] = struct.pack("<H", 999)
    good = packed.getvalue()
    files = spark.createDataFrame([("bad.zip", bytes(data)), ("good.zip", good)], "path string, content binary")
    rows = {r.path: (r.content, r.error) for r in members.member_contents(files).collect()}
    assert rows["good.zip"][0] == b"x" and rows["bad.zip"][0] is None and rows["bad.zip"][1]


@pytest.mark.parametrize(
    ("path", "uri"),
    [
        ("s3a://bucket/a b%.bin", "s3://bucket/a%20b%25.bin"),
        ("file:/tmp/a%20b", "file:///tmp/a%2520b"),
        ("file:///tmp/x", "file:///tmp/x"),
        ("/tmp/a b", "file:///tmp/a%20b"),
        ("hdfs://host:8020/x", "hdfs://host:8020/x"),
    ],
)
def test_uris(path, uri):
    assert chunks.arrow_uri(path) == uri


def test_open_with_a_blank(tmp_path: Path):
    (tmp_path / "a b.bin").write_bytes(b"data")
    with chunks._open(f"file:{tmp_path}/a b.bin") as handle:
        assert handle.read() == b"data"


def test_plain_dependency_files(spark):
    rows = [
        ("d/requirements.txt", None, b"requests==1\n"),
        ("d/pyproject.toml", None, b'dependencies = [\n  "numpy>=1",\n]\n'),
        ("d/setup.py", None, b"setup(install_requires=['flask'])"),
        ("p.tar.gz", "p/requirements.txt", b"jinja2\n"),
        ("w.whl", "w.dist-info/METADATA", b"Requires-Dist: click\n"),
        ("d/model.bin", None, b"requests"),
        ("e.zip", "requirements.txt", None),
    ]
    files = spark.createDataFrame(rows, "path string, entry string, content binary")
    assert {(r.path, r.name) for r in dependencies(files).collect()} == {
        ("d/requirements.txt", "requests"), ("d/pyproject.toml", "numpy"), ("d/setup.py", "flask"), ("p.tar.gz", "jinja2"), ("w.whl", "click"),
    }
    assert deps.dependency_files(files).count() == 6
