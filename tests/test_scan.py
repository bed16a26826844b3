"""Whole scans over inert files, from disk to findings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tamperlens.operators import algebra, formats
from tamperlens.plans.scan import issues, scan
from tamperlens.schema import FINDINGS
from tamperlens.sources import artifacts as A
from tamperlens.sources import binary, chunks, members
from tamperlens.sources import reports as R


@pytest.fixture(scope="module")
def files(spark, model_dir):
    return A.artifacts(spark, str(model_dir), extensions=[])


@pytest.fixture(scope="module")
def findings(files, tmp_path_factory):
    # Scanned once; the tests read the written table.
    out = str(tmp_path_factory.mktemp("out") / "findings")
    scan(files, work=str(tmp_path_factory.mktemp("work"))).write.parquet(out)
    return files.sparkSession.read.schema(FINDINGS).parquet(out).cache()


def kinds(findings, name):
    rows = findings.where(F.endswith("path", F.lit("/" + name))).select("vulnerability_type", "severity.level").collect()
    return {(r[0], r[1]) for r in rows}


def test_contract(findings):
    assert findings.schema == FINDINGS
    assert findings.where("finding_id IS NULL OR severity.cvss_vector IS NULL").count() == 0


def test_pickles(findings):
    assert kinds(findings, "imports.pkl") >= {
        ("Pickle Exploit Payload - Code Execution Imports (targets pickle.load())", "Critical")
    }
    assert not [k for k in kinds(findings, "benign.pkl") if k[0].startswith("Pickle")]
    assert not [k for k in kinds(findings, "broken.pkl") if k[0].startswith("Pickle")]
    assert not [k for k in kinds(findings, "empty.pth") if k[0].startswith("Pickle")]


def test_archives(findings):
    assert kinds(findings, "slip.zip") >= {("Zip Slip - Path Traversal", "High"), ("Zip Slip - Absolute Path", "Medium")}
    assert not [k for k in kinds(findings, "safe.npz") if "Slip" in k[0]]
    assert kinds(findings, "link.tar") >= {("Tar Slip - Path Traversal", "High"), ("Tar Slip - Dangerous Symlink", "High")}
    assert kinds(findings, "packed.tar.gz") >= {("Tar Slip - Path Traversal", "High")}


def test_keras(findings):
    found = {k[0] for k in kinds(findings, "lambda.keras")}
    assert "Keras Exploit Payload - Lambda Layer RCE (targets CVE-2024-3660)" in found
    assert {"Keras - Dangerous Module Import", "Keras - DoS via Large Layer"} <= found


def test_gguf(findings):
    found = {k[0] for k in kinds(findings, "count.gguf")}
    assert "GGUF - Tensor Count Integer Overflow Exploit (CVE-2024-21836)" in found
    assert "GGUF - Integer Overflow Pattern (max uint64)" in found
    assert "GGUF - Jinja2 SSTI Remote Code Execution" in {k[0] for k in kinds(findings, "template.gguf")}


def test_other_detectors(findings):
    assert ("Graph Injection - Python Execution", "Critical") in kinds(findings, "graph.pb")
    # Far values are outliers and leave most of the histogram empty: two anomalies.
    assert ("Neural Backdoor - Weight Anomalies", "Medium") in kinds(findings, "spikes.safetensors")
    assert ("Metadata - Format String", "Medium") in kinds(findings, "spikes.safetensors")
    assert ("Polyglot - Trailing Data", "High") in kinds(findings, "looks.png")
    assert {k[0] for k in kinds(findings, "wrong.onnx")} >= {
        "Polyglot - Format Mismatch", "External Reference - SSRF Vector", "External Reference - Unknown Domains"
    }
    assert ("Dependency Hijacking - Typosquatting", "High") in kinds(findings, "pkg.whl")
    assert ("Secrets - token assignment", "Critical") in kinds(findings, "notes.txt")


def test_secret_is_masked(findings):
    row = findings.where("scanner = 'secrets'").select("evidence").first()
    assert row["evidence"]["masked"] == "toke***"


def test_include_and_exclude(files):
    only = scan(files, include=["zip_slip"]).select("scanner").distinct().collect()
    assert [r[0] for r in only] == ["zip_slip"]


def test_issues(files):
    rows = {(r["path"].split("/")[-1], r["scanner"]) for r in issues(files).collect()}
    assert ("legacy.ggml", "gguf") in rows and ("badjson.keras", "lambda_layer") in rows
    assert ("saved", "graph_injection") in rows


def test_empty_input(spark, files, tmp_path):
    nothing = files.where("false")
    assert scan(nothing, work=str(tmp_path)).count() == 0


def test_gate_and_summary(findings):
    gate = algebra.gate(findings).first()
    assert gate["failed"] and gate["critical"] > 0
    totals = algebra.summary(findings).where("target IS NULL").first()
    assert totals["total_vulnerabilities"] == findings.count()


def test_members_match_zipfile(spark, files):
    listed = members.zip_members(files.where(F.endswith("path", F.lit("slip.zip")))).where("origin = 'central'")
    assert sorted(r["entry"] for r in listed.collect()) == ["../up.txt", "/abs.txt", "ok.txt"]


def test_imports_agree_with_opcode_table(files):
    from tamperlens.operators import pickles

    streams = binary.pickle_streams(files.where(F.endswith("path", F.lit(".pkl"))), members.member_contents(files.where("false")))
    direct = binary.pickle_imports(streams).collect()
    table = pickles.imports(binary.opcodes(streams)).collect()
    assert sorted(map(str, direct)) == sorted(map(str, table)) and direct


def test_chunks_cover_the_file_and_cross_boundaries(spark, tmp_path):
    from tamperlens.operators import gguf

    text = b"x" * 95 + b"{{ a.__class__ }}" + b"y" * 300
    (tmp_path / "a.gguf").write_bytes(text)
    cut = chunks.chunks(spark, str(tmp_path), chunk=100, halo=40)
    covered = chunks.coverage(cut).first()
    assert (covered["chunks"], covered["bytes_scanned"]) == (5, len(text))
    found = gguf.template_injection(gguf.chunk_texts(cut)).collect()
    assert [(r["evidence"]["pattern"], r["evidence"]["offset"]) for r in found] == [("{{.*__class__", "95")]


def test_reports_round_trip(spark, findings, tmp_path):
    R.write_json(findings, str(tmp_path / "json"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sum(len(d["vulnerabilities"]) for d in lines) == findings.count()
    assert all(d["summary"]["total_vulnerabilities"] == len(d["vulnerabilities"]) for d in lines)
    for i, document in enumerate(lines):
        (tmp_path / f"r{i}.json").write_text(json.dumps(document))
    back = R.read_reports(spark, str(tmp_path / "r*.json"))
    assert sorted(r[0] for r in back.select("finding_id").collect()) == sorted(r[0] for r in findings.select("finding_id").collect())


def test_sarif_documents(spark, findings, tmp_path):
    R.write_sarif(findings, str(tmp_path / "sarif"))
    documents = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "sarif")).collect()]
    assert all(d["version"] == "2.1.0" and len(d["runs"][0]["tool"]["driver"]["rules"]) == 10 for d in documents)
    levels = {r["level"] for d in documents for r in d["runs"][0]["results"]}
    assert levels <= {"error", "warning", "note"}


def test_format_of_directories(spark, files):
    rows = {r["directory"].split("/")[-1]: r["format"] for r in formats.directory_formats(files.select("path")).collect()}
    assert rows["saved"] == "tensorflow_saved_model"


def test_binary_flag(spark):
    rows = spark.createDataFrame([("a", b"text\n"), ("b", b"a\0b"), ("c", b"\x01" * 5 + b"abc"), ("d", b"")], "n string, content binary")
    got = {r["n"]: r["b"] for r in rows.select("n", formats.is_binary(F.col("content")).alias("b")).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}
