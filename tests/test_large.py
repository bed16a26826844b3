"""Files read in chunks and pages give the findings of files read whole."""

from __future__ import annotations

import io
import pickle
import struct
import tarfile

import numpy as np
import pytest
from made_files import gguf_bytes, gguf_entry, import_pickle, safetensors_bytes, tar_bytes, zip_bytes
from pyspark.sql import functions as F

from tamperlens.operators import gguf, metadata
from tamperlens.plans.scan import scan, scan_files
from tamperlens.sources import artifacts as A
from tamperlens.sources import binary, chunks, members, paged

CHUNK = 65_536


def lines(n, k=0):
    return b"".join(b"line %d of some text\n" % (i + k) for i in range(n))


def made():
    rng = np.random.default_rng(3)
    noise = lambda n: rng.integers(1, 255, n, dtype=np.uint8).tobytes()
    quiet = lambda n: bytes(rng.integers(97, 122, n, dtype=np.uint8))
    spiky = rng.normal(size=40_000).astype("float32")
    spiky[:800] = 60
    text = lines(2000) + b"os.system('x')\n" + lines(3000, 7) + b'api_key = "abcdefgh12345678abcd"\n' + lines(4000) + b'api_key = "zzzzzzzz12345678abcd"\n'
    urls = lines(2500) + b"http://169.254.169.254/x\n" + lines(5000) + b"https://cdn.example.net/a.bin https://cdn.example.net/a.bin file:///etc/x\n" + lines(2000)
    kv = [gguf_entry(f"k{i}", 8, struct.pack("<Q", 9000) + quiet(9000)) for i in range(30)]
    kv += [gguf_entry("tokenizer.chat_template", 8, struct.pack("<Q", 40) + b"{{ x.__class__ }}" + b" " * 23), gguf_entry("bad", 99, b"")]
    tensor = struct.pack("<Q", 3) + b"w.x" + struct.pack("<I", 1100) + struct.pack("<Q", 2) * 1100 + b"\0" * 12
    zipped = {f"m{i}.txt": noise(9000).replace(b"PK", b"..") for i in range(30)} | {"../up.txt": b"x", "/abs.txt": b"x", "n" * 3000 + "/../z": b"y"}
    long_name = io.BytesIO()
    with tarfile.open(fileobj=long_name, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, size in (("d" * 120 + "/../../../evil.txt", 5), ("big.bin", 200_000), ("inner.tar", 10_240)):
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(tar_bytes([("../hidden", b"x", None)])[:size].ljust(size, b"\0") if name == "inner.tar" else b"\0" * size))
    state = pickle.dumps({f"key{i}": "v" * 50 for i in range(4000)})[:-1] + import_pickle("os", "system")[2:]
    return {
        "text.h5": text, "notes.txt": text, "urls.onnx": urls, "graph.pb": quiet(100_000) + b"PyFunc" + quiet(100_000) + b"ReadFile",
        "dir.gguf": gguf_bytes(entries=kv, rest=b"\x1d" * 8 + quiet(70_000) + b"\xef\xbe\xad\xde" + quiet(9000)),
        "dims.gguf": gguf_bytes(tensors=2, rest=tensor + tensor + quiet(90_000)),
        "slip.zip": zip_bytes(zipped), "long.tar": long_name.getvalue(),
        "state.pkl": state, "w.safetensors": safetensors_bytes({"w": ("F32", spiky.tobytes())}, {"note": "100%n", "more": "x" * 150_000}),
        "looks.png": b"\x89PNG\r\n\x1a\n" + quiet(80_000) + b"IEND\xae\x42\x60\x82" + b"MZ" + quiet(70_000) + b"IEND1234",
        "looks.gif": b"GIF89a" + quiet(65_520) + b";" + quiet(40_000) + b";" + b"PK\x03\x04" + quiet(500),
        "requirements.txt": b"numpyy>=1\n" + b"# note\n" * 20_000 + b"-i http://10.0.0.1/simple\n",
    }


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    for name, data in made().items():
        (folder / name).write_bytes(data)
    return A.artifacts(spark, str(folder), extensions=[])


def plain(findings):
    rows = findings.withColumn("evidence", F.map_filter("evidence", lambda k, _: k != "context")).collect()
    return sorted((r.path.split("/")[-1], r.scanner, r.vulnerability_type, r.severity.level, r.description, str(sorted(r.evidence.items()))) for r in rows)


def test_findings_are_those_of_whole_files(spark, files, tmp_path):
    whole = plain(scan(files, work=str(tmp_path / "whole")))
    cut = plain(scan_files(files.select("path"), work=str(tmp_path / "cut"), chunk=CHUNK))
    assert cut == whole
    met = {r[1] for r in whole}
    assert met >= {"pickle", "lambda_layer", "secrets", "gguf", "zip_slip", "polyglot", "external_ref", "metadata", "backdoor", "graph_injection", "dependency"}
    kinds = {(r[0], r[2]) for r in whole}
    assert ("long.tar", "Tar Slip - Path Traversal") in kinds
    assert ("dims.gguf", "GGUF - Tensor Dimension Overflow (CVE-2024-21802)") in kinds
    assert {m for m in kinds if m[0] == "dir.gguf"} >= {("dir.gguf", "GGUF - Exploit Marker (DEADBEEF)"), ("dir.gguf", "GGUF - Invalid Metadata Type")}


def test_tables_by_path_are_those_by_content(files):
    paths = files.select("path")
    for read in (binary.gguf_kv, binary.gguf_tensors, members.tar_members, metadata.safetensors_headers):
        some = F.lower("path").rlike({binary.gguf_kv: "gguf$", binary.gguf_tensors: "gguf$", members.tar_members: "tar$"}.get(read, "safetensors$"))
        a, b = (sorted(map(str, read(f.where(some)).collect())) for f in (files, paths))
        assert a == b and a
    entries = [r.entry for r in members.tar_members(paths.where(F.endswith("path", F.lit("long.tar")))).collect()]
    assert entries == ["d" * 120 + "/../../../evil.txt", "big.bin", "inner.tar"]
    dims = binary.gguf_tensors(paths.where(F.endswith("path", F.lit("dims.gguf")))).collect()
    assert [(r.idx, r.n_dims) for r in dims] == [(0, 1100), (1, 1100)]
    assert gguf.kv_checks(binary.gguf_kv(paths.where(F.endswith("path", F.lit("dir.gguf"))))).count() == 1


def test_pages_hold_little_and_skip_much():
    data = bytes(range(256)) * 4096
    pages = paged.Pages(io.BytesIO(data), len(data), page=1000, held=2)
    assert pages[5:17] == data[5:17] and pages[999:3005] == data[999:3005] and pages[len(data) - 3 :] == data[-3:]
    assert len(pages.pages) == 2
    before = pages.fetched
    with paged.stream(pages) as file:
        file.seek(500_000)
        assert file.read(10) == data[500_000:500_010] and file.readline() == data[500_010 : data.index(b"\n", 500_010) + 1]
    assert pages.fetched - before < 80


@pytest.mark.parametrize("size", [37, 64, 1000])
def test_aligned_chunks_are_the_file_once(spark, tmp_path, size):
    data = (b"word " * 9 + b"\n") * 20 + b"x" * 300 + b"\0tail" + b"\n" * 5 + b"end"
    (tmp_path / "a.txt").write_bytes(data)
    listed = spark.createDataFrame([(str(tmp_path / "a.txt"), len(data))], "path string, length long")
    cut = chunks.read(chunks.plan(listed, size), size, 60)
    rows = cut.select("offset", chunks.aligned(size, 60).alias("t")).orderBy("offset").collect()
    assert "".join(r.t for r in rows).encode("latin-1") == data
