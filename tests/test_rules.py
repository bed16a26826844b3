"""Thresholds on both sides, and detectors against brute force on small inputs."""

from __future__ import annotations

import hashlib
import random
import struct
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from made_files import gguf_bytes
from tamperlens.operators import cvss, deps, gguf, metadata, pickles, refs, textscan, weights
from tamperlens.plans import inputs
from tamperlens.rules import markers as M
from tamperlens.rules import text_rules as R
from tamperlens.sources import binary
from tamperlens.streaming import incremental


def texts(spark, *rows):
    return spark.createDataFrame([(f"t{i}", f"t{i}", t) for i, t in enumerate(rows)], "path string, source string, text string")


def test_every_rule_has_a_marker_and_its_anchor(spark):
    words = [w.replace("~", "\\").replace("^", "'") for w in inputs.MARKERS]
    found = textscan.rules_scan(texts(spark, *words)).select(
        F.col("evidence")["category"].alias("c"), F.col("evidence")["pattern"].alias("p")
    ).distinct().collect()
    assert {(r["c"], r["p"]) for r in found} == {(rule.category, rule.description) for rule in R.ALL_RULES}


def test_rules_on_null_and_empty(spark):
    assert textscan.rules_scan(texts(spark, None, "")).count() == 0


def test_same_description_is_one_finding(spark):
    assert textscan.rules_scan(texts(spark, "bytes.fromhex ( and bytearray.fromhex")).count() == 1


@pytest.mark.parametrize("reduces, globals_, reasons", [(10, 20, 0), (11, 20, 1), (10, 21, 1), (11, 21, 2)])
def test_obfuscation_limits(spark, reduces, globals_, reasons):
    ops = [("s", i, "REDUCE") for i in range(reduces)] + [("s", 100 + i, "GLOBAL") for i in range(globals_)]
    rows = spark.createDataFrame(ops, "source string, seq bigint, opcode string").withColumn("arg", F.lit(None).cast("string"))
    found = pickles.obfuscation(pickles.opcode_counts(rows), pickles.opcode_text_marks(rows)).collect()
    assert sum(len(r["reasons"]) for r in found) == reasons


def test_memo_slots_written_twice(spark):
    ops = [("BINUNICODE", "os"), ("BINPUT", "0"), ("BINUNICODE", "torch"), ("BINPUT", "0"), ("BINUNICODE", "x"),
           ("BINGET", "0"), ("BINUNICODE", "nn"), ("STACK_GLOBAL", None)]
    rows = spark.createDataFrame([("s", i, i, o, a) for i, (o, a) in enumerate(ops)], "source string, seq bigint, pos bigint, opcode string, arg string")
    assert [(r["module"], r["name"]) for r in pickles.imports(rows).collect()] == [("torch", "nn")]


@pytest.mark.parametrize("count, kinds", [
    (100_000, []), (100_001, ["GGUF - Excessive Tensor Count (DoS)"]),
    ((2**63 - 1) // 88, ["GGUF - Excessive Tensor Count (DoS)", "GGUF - Tensor Count/File Size Mismatch"]),
    ((2**63 - 1) // 88 + 1, ["GGUF - Tensor Count Integer Overflow (CVE-2024-21836)"]),
    (2**64 - 1, ["GGUF - Tensor Count Integer Overflow Exploit (CVE-2024-21836)"]),
    (2**63, ["GGUF - Tensor Count Integer Overflow (CVE-2024-21836)"]),
])
def test_tensor_counts(spark, count, kinds):
    size = 10**6 if count < 10**6 else 24
    rows = spark.createDataFrame([("g", size, gguf_bytes(tensors=count))], "path string, length bigint, content binary")
    found = gguf.tensor_count_check(gguf.headers(rows)).select("vulnerability_type").collect()
    assert sorted(r[0] for r in found) == sorted(kinds)


def test_short_header_is_null(spark):
    rows = spark.createDataFrame([("g", 10, b"GGUF\x03\0\0\0\x01\0")], "path string, length bigint, content binary")
    assert tuple(gguf.headers(rows).select("version", "n_tensors", "n_kv").first()) == (3, None, None)


def test_tensor_size_at_the_limit(spark):
    rows = spark.sql(
        "SELECT path, 0 AS idx, cast(0 AS bigint) AS offset, cast(4 AS decimal(20,0)) AS name_len, cast(2 AS bigint) AS n_dims, "
        "transform(dims, d -> cast(d AS decimal(20,0))) AS dims FROM VALUES "
        "('fits', array('4611686018427387904', '1')), ('over', array('4611686018427387904', '2')), "
        "('marker', array('3405691582', '9223372036854775808')) AS t(path, dims)"
    )
    found = {r["path"]: r["vulnerability_type"] for r in gguf.tensor_checks(rows).collect()}
    assert found == {"over": "GGUF - Integer Overflow in Tensor Size", "marker": "GGUF - Tensor Dimension Exploit Value"}


def test_gguf_walk_skips_string_arrays_and_tensor_tails(spark):
    words = struct.pack("<IQ", 8, 2) + struct.pack("<Q", 2) + b"ab" + struct.pack("<Q", 1) + b"c"
    entry = struct.pack("<Q", 1) + b"k" + struct.pack("<I", 9) + words
    last = struct.pack("<Q", 1) + b"z" + struct.pack("<II", 4, 7)
    tensor = struct.pack("<Q", 1) + b"t" + struct.pack("<I", 1) + struct.pack("<Q", 5) + b"\0" * 12
    content = gguf_bytes(tensors=2, entries=[entry, last], rest=tensor * 2)
    rows = spark.createDataFrame([("g", content)], "path string, content binary")
    kv = binary.gguf_kv(rows).orderBy("idx").collect()
    assert [(r["key"], r["value_type"]) for r in kv] == [("k", 9), ("z", 4)]
    tensors = binary.gguf_tensors(rows).orderBy("idx").collect()
    assert [[int(d) for d in r["dims"]] for r in tensors] == [[5], [5]]


@pytest.mark.parametrize("n, level", [(3, "Medium"), (4, "High")])
def test_unknown_domain_levels(spark, n, level):
    row = texts(spark, " ".join(f"https://host{i}.example/path" for i in range(n)))
    assert refs.reference_findings(row).first()["severity"]["level"] == level
    assert refs.unknown_domains(refs.urls(row)).first()["severity"]["level"] == level


def test_allowed_domains(spark):
    hosts = {"github.com": True, "api.github.com": True, "notgithub.com": False, "github.com.evil.example": False}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", refs.is_allowed(F.col("h")).alias("ok"))
    assert {r["h"]: r["ok"] for r in rows.collect()} == hosts


def test_narrow_references_agree_with_grouped_ones(spark):
    rows = texts(
        spark, "http://10.0.0.1/a file:///etc/hosts https://x.example/a https://y.example/b", "https://github.com/a",
        "none", "HTTP://LOCALHOST/x s3://bucket/key",
    )
    urls = refs.urls(rows)
    grouped = refs.ssrf(rows).unionByName(refs.local_files(urls)).unionByName(refs.unknown_domains(urls))
    key = lambda df: sorted(str((r["source"], r["vulnerability_type"], sorted(r["evidence"].items()))) for r in df.collect())
    assert key(refs.reference_findings(rows)) == key(grouped)


def test_lookalikes_against_brute_force(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz-_"
    names = set(M.POPULAR_PACKAGES[::5])
    for popular in M.POPULAR_PACKAGES:
        for _ in range(6):
            word = list(popular)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(word))
                change = rng.choice(["drop", "add", "swap", "set"])
                if change == "drop" and len(word) > 1:
                    word.pop(at)
                elif change == "add":
                    word.insert(at, rng.choice(letters))
                elif change == "swap" and at:
                    word[at - 1], word[at] = word[at], word[at - 1]
                else:
                    word[at] = rng.choice(letters)
            names.add("".join(word))
    plain = lambda s: s.lower().replace("-", "").replace("_", "")
    targets = {plain(p) for p in M.POPULAR_PACKAGES}
    want = {}
    for name in names:
        a, best = plain(name), None
        if a in targets:
            continue
        for popular in sorted(M.POPULAR_PACKAGES):
            b = plain(popular)
            score = SequenceMatcher(None, a, b).ratio()
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                score = max(score, 0.95)
            if abs(len(a) - len(b)) == 1:
                long, short = (a, b) if len(a) > len(b) else (b, a)
                if any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
                    score = max(score, 0.92)
            if score >= 0.85 and (best is None or score > best[1]):
                best = (popular, score)
        if best:
            want[name] = best
    rows = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = {r["name"]: (r["target"], r["similarity"]) for r in deps.lookalikes(rows, deps.popular_packages(spark)).collect()}
    assert got == want


@pytest.mark.parametrize("far, found", [(10, False), (11, True)])
def test_one_percent_of_outliers(spark, far, found):
    n = 1000
    values = [1000.0 if i < far else float(i % 7) for i in range(n)]
    rows = spark.createDataFrame([("m", "l", i, v) for i, v in enumerate(values)], "path string, layer string, pos bigint, value double")
    assert bool(weights.outliers(weights.sliced(rows, 300)).count()) is found


@pytest.mark.parametrize("n, found", [(1000, False), (1001, True)])
def test_uniqueness_limit(spark, n, found):
    rows = spark.range(n).select(F.lit("m").alias("path"), F.lit("l").alias("layer"), F.col("id").alias("pos"), (F.col("id") % 5).cast("double").alias("value"))
    assert bool(weights.uniqueness(weights.sliced(rows, 300)).count()) is found


@pytest.mark.parametrize("n, issues", [(99, 0), (100, 1)])
def test_constant_layer(spark, n, issues):
    rows = spark.range(n).select(F.lit("m").alias("path"), F.lit("l").alias("layer"), F.col("id").alias("pos"), F.lit(1.0).alias("value"))
    assert weights.entropy(weights.sliced(rows, 30)).where("issue = 'constant_values'").count() == issues


def test_bf16_and_f16(spark):
    data = {"F16": struct.pack("<2e", 1.5, -2.0), "BF16": b"\xc0\x3f\x00\xc0"}
    rows = spark.createDataFrame([("p", d, d, 0, b) for d, b in data.items()], "path string, layer string, dtype string, first_pos bigint, data binary")
    got = sorted((r["layer"], r["pos"], r["value"]) for r in binary.exploded(binary.decode_slices(rows)).collect())
    assert got == [("BF16", 0, 1.5), ("BF16", 1, -2.0), ("F16", 0, 1.5), ("F16", 1, -2.0)]


def test_field_length_limit(spark):
    rows = texts(spark, "x" * 100_000, "x" * 100_001).withColumnRenamed("text", "value").withColumn("name", F.lit("n"))
    assert [r["path"] for r in metadata.field_length(rows).collect()] == ["t1"]


def test_json_depth_bound_is_an_issue(spark):
    from tamperlens.operators import jsonwalk

    rows = texts(spark, '{"a": ' * 3 + '"x"' + "}" * 3)
    assert metadata.json_fields(rows, 3).count() == 1
    assert metadata.json_fields(rows, 2).count() == 0
    assert jsonwalk.depth_issues(jsonwalk.leaves(rows, 2), "metadata").count() == 1


def test_preset_scores(spark):
    got = {r["preset"]: (r["score"], r["level"]) for r in cvss.presets(spark).collect()}
    # By hand for ssrf: 1.08 * (2.727 + 3.887) = 7.143, to the nearest tenth.
    assert got["rce_network"] == (9.8, "Critical") and got["dos"] == (7.5, "High") and got["ssrf"] == (7.1, "High")


def test_stream_resumes_and_takes_changed_files_again(spark, tmp_path):
    from tamperlens.plans.scan import scan_files

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text('token = "abcdefgh12345678"')
    scanned = lambda found: scan_files(found.select("path"), include=["secrets"], chunk=1 << 20).select("path")
    runs = iter(range(100))

    def run(detect=lambda found: found.select("path")):
        out = str(tmp_path / f"out{next(runs)}")
        incremental.announce(spark, str(source), str(tmp_path / "inbox"))
        stream = incremental.versions(spark, str(tmp_path / "inbox"))
        incremental.scan_changed_stream(stream, detect, out, str(tmp_path / "progress")).awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.schema("path string").parquet(out).collect())

    assert run(scanned) == ["a.txt"]
    (source / "b.txt").write_text('password = "abcdefgh12345678"' + " " * 3_000_000 + "1")
    assert run() == ["b.txt"]
    assert run() == []
    # Equal size, another byte behind the first pages; and a new time without a new byte.
    (source / "b.txt").write_text('password = "abcdefgh12345678"' + " " * 3_000_000 + "2")
    (source / "a.txt").write_text('token = "abcdefgh12345678"')
    assert run() == ["b.txt"]
    plain = incremental.scan_stream(
        incremental.artifact_stream(spark, str(source)),
        lambda files: textscan.secrets_scan(files.select("path", F.col("path").alias("source"), F.col("content").cast("string").alias("text"))),
        str(tmp_path / "o2"), str(tmp_path / "p2"),
    )
    plain.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2


def test_stream_keeps_one_state_for_many_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "GROUPS", 3, raising=False)
    there = tmp_path / "there.txt"
    there.write_text("words")
    runs = iter(range(100))

    def run(*drop):
        out = str(tmp_path / f"out{next(runs)}")
        spark.createDataFrame(drop, incremental.VERSIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        stream = incremental.versions(spark, str(tmp_path / "inbox"))
        query = incremental.scan_changed_stream(stream, lambda rows: rows, out, str(tmp_path / "progress"))
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
        return sorted(tuple(r) for r in spark.read.schema(incremental.VERSIONS).parquet(out).drop("batch").collect())

    first = [(f"p{k:02}", 1, 5, f"a{k}") for k in range(40)]
    file, gone = (str(there), 1, 5, None), (str(tmp_path / "gone.txt"), 1, 5, None)
    read = hashlib.sha256(b"words").hexdigest()
    assert run(*first, file, gone, (None, 1, 5, "x"), ("n", None, 5, "x")) == sorted([*first, (*file[:3], read)])
    # The newest of a batch counts, the latest batch even where its time is earlier; a new time alone is no change.
    later = [("p00", 2, 5, "b"), ("p00", 3, 5, "c"), ("p01", 2, 6, "a1"), ("p02", 0, 5, "z"), first[3], file, ("q", 1, 1, "q")]
    assert run(*later) == [("p00", 3, 5, "c"), ("p02", 0, 5, "z"), ("q", 1, 1, "q")]
    there.write_text("other")
    assert run(first[0], ("p01", 1, 5, "a1"), first[2], file) == [first[0], first[2]]
    assert run((str(there), 2, 5, None)) == [(str(there), 2, 5, hashlib.sha256(b"other").hexdigest())]


def test_checkpoint_folder_is_shared_but_for_local_sessions(spark):
    from types import SimpleNamespace as Made

    session = lambda master, named: Made(conf=Made(get=lambda key, other: named), sparkContext=Made(master=master))
    assert incremental.checkpoint_dir(session("spark://host:1", "/shared/base/"), "x") == "/shared/base/x"
    assert incremental.checkpoint_dir(session("local[2]", None), "x").endswith("/x")
    for master in ("spark://host:1", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            incremental.checkpoint_dir(session(master, None), "x")


def test_json_of_any_depth(spark):
    from tamperlens.operators import jsonwalk, keras

    text = '{"class_name": "Lambda", "config": {"function": "x"}}'
    for _ in range(50):
        text = '{"class_name": "Model", "config": {"layers": [' + text + "]}}"
    rows = texts(spark, text, '{"a": [], "b": {}, "c": [[["deep", 1, null]]], "d": "x"}', "not json", '"lone"', "[" * 5000)
    nodes = keras.config_nodes(rows)
    layers = nodes.where("class_name = 'Lambda'").collect()
    assert [(r.source, r.config_path) for r in layers] == [("t0", "/config/layers[0]" * 50)]
    assert nodes.where("source = 't0' and class_name = 'Model'").count() == 50
    found = {(r.source, r.json_path, r.name, r.in_list, r.value) for r in jsonwalk.leaves(rows.where("source <> 't0'")).collect()}
    assert found == {
        ("t1", "/a", "a", False, None), ("t1", "/b", "b", False, None), ("t1", "/c[0][0][0]", None, True, "deep"), ("t1", "/c[0][0][1]", None, True, None),
        ("t1", "/c[0][0][2]", None, True, None), ("t1", "/d", "d", False, "x"), ("t3", "", None, False, "lone"),
    }
    assert sorted(r.path for r in jsonwalk.parse_issues(rows, "metadata").collect()) == ["t2", "t4"]
