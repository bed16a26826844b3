"""What must not grow faster than the tables: tasks, folds, and expressions worked out several times a row."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tamperlens.functions.groups import fixed
from tamperlens.operators import deps, jsonwalk, keras, metadata, pickles, weights
from tamperlens.plans import inputs as I
from tamperlens.plans import queries_reports
from tamperlens.rules import text_rules as R
from tamperlens.sources import binary

SECRET = "token: ghp_" + "a1" * 18


def test_streamed_table_may_be_a_folder(spark, tmp_path):
    rows = [(k, SECRET if k % 2 else "plain words", "en", "web", 11) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    found = [sorted(r.source for r in queries_reports.stream_scan(spark, str(tmp_path / x)).collect()) for x in ("folder", "file")]
    assert found[0] == found[1] == [f"doc/{k}" for k in (1, 3, 5, 7)]


def test_layer_of_many_slices(spark):
    """A mean worked out anew for every slice took minutes here."""
    rng = np.random.default_rng(3)
    values = rng.normal(4, 2, 6000)
    rows = [("p", "l", k, [float(v)]) for k, v in enumerate(values)]
    slices = spark.createDataFrame(rows, "path string, layer string, first_pos long, values array<double>")
    begun = time.time()
    found = weights.layer_stats(slices).collect()[0]
    assert time.time() - begun < 20
    assert (found.n, found.steps, found.low, found.high) == (6000, 5999, values.min(), values.max())
    assert np.allclose([found.mean, found.std, found.diff_std], [values.mean(), values.std(), np.diff(values).std()], rtol=1e-9)


def test_anomalies_read_stored_tables(spark, tmp_path):
    rows = [("p", "l", k * 50, [float(v % 3) for v in range(50)]) for k in range(40)]
    slices = spark.createDataFrame(rows, "path string, layer string, first_pos long, values array<double>")

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    assert weights.anomalies(slices).exceptAll(weights.anomalies(slices, keep=keep)).count() == 0


def test_tasks_share_the_rows_of_one_row_group(spark, tmp_path):
    n = 20_000
    pq.write_table(pa.table({"id": np.arange(n), "text": ["some words to fill a row group " * 8] * n}), tmp_path / "t.parquet", row_group_size=n, compression="none", use_dictionary=False)
    read = spark.read.parquet(str(tmp_path / "t.parquet"))
    dealt = I.spread(read)
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == n and max(held) <= n / 3
    assert dealt.agg(F.sum("id")).first()[0] == n * (n - 1) // 2


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_ROWS", 50)
    dealt = I.spread(spark.range(0, 1000, 1, 2))
    assert dealt.rdd.getNumPartitions() == 20
    assert I.spread(spark.range(0)).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requirement_is_read_once_a_line(spark):
    texts = spark.createDataFrame([("r", "r", "numpy==1\n# no\n\n--index-url https://x\nPandas ; os\ngit+https://x/y")], "path string, source string, text string")
    found = deps.requirements(texts)
    assert sorted(map(tuple, found.select("name", "raw", "dep_type").collect())) == [
        ("__custom_index__", "--index-url https://x", "custom_index"), ("__url_dependency__", "git+https://x/y", "url"),
        ("numpy", "numpy==1", "package"), ("pandas", "Pandas", "package"),
    ]
    alone = _plan(found).count("split_part")
    assert _plan(found.where("dep_type = 'package'").select("name").distinct()).count("split_part") <= alone


def test_derived_content_is_made_once_a_row(spark):
    made = spark.range(3).select(F.col("id").cast("string").alias("path"), F.unhex(F.concat(F.lit("07000000000000007B7D"), F.lpad(F.hex("id"), 2, "0"))).alias("content"))
    found = metadata.safetensors_headers(fixed(made, content=F.col("content")))
    assert _plan(found.where(F.col("header_size") > 5)).count("unhex") == 1
    assert [(r.path, int(r.header_size)) for r in found.sort("path").collect()] == [(str(k), 7) for k in range(3)]


def test_json_is_parsed_once_a_text(spark):
    texts = spark.createDataFrame([("a", "a", '{"x": "y"}'), ("b", "b", "no json"), ("c", "c", None)], "path string, source string, text string")
    found = jsonwalk.leaves(texts)
    assert _plan(found).count("parse_json") + _plan(found).count("parseJson") <= 1
    assert [(r.path, r.json_path, r.value) for r in found.collect()] == [("a", "/x", "y")]


def test_url_of_a_node_is_looked_up_once(spark):
    text = '{"class_name": "A", "origin": "http://LOCALHOST/x", "loader": "get_file"}'
    found = keras.url_ssrf(keras.config_nodes(spark.createDataFrame([("a", "a", text)], "path string, source string, text string")))
    assert _plan(found).count("get_file") == 1
    assert found.collect()[0].evidence["url"] == "http://LOCALHOST/x"


def test_script_of_a_field_is_told_once(spark):
    fields = spark.createDataFrame([("a", "a", "f", "<script>x"), ("a", "a", "g", "plain"), ("a", "a", "h", None)], "path string, source string, name string, value string")
    found = metadata.embedded_script(fields)
    assert _plan(found).count("RLIKE") <= len(R.SCRIPTS)
    assert [r.evidence["field"] for r in found.collect()] == ["f"]


def test_fields_are_walked_once(spark):
    values = ["<script>x %5$x", "plain", "x" * 100_001, "100%n", None]
    fields = spark.createDataFrame([("a", "a", f"f{k}", v) for k, v in enumerate(values)], "path string, source string, name string, value string")
    apart = [metadata.field_length(fields), metadata.format_string(fields), metadata.embedded_script(fields)]
    told = lambda df: sorted((r.vulnerability_type, r.description, sorted(r.evidence.items()), r.finding_id, r.severity, r.cwe_id) for r in df.collect())
    assert told(metadata.field_findings(fields)) == sorted(row for df in apart for row in told(df))
    assert _plan(metadata.field_findings(fields)).count("LogicalRDD") + _plan(metadata.field_findings(fields)).count("LocalRelation") == 1


def test_small_blocks_leave_together():
    kind = pa.list_(pa.struct([("seq", pa.int64()), ("opcode", pa.string()), ("arg", pa.string())]))
    ops = [{"seq": 0, "opcode": "GLOBAL", "arg": "os system"}, {"seq": 1, "opcode": "REDUCE", "arg": None}]
    names = ["source", "blk", "ops", "filled", "front"]
    columns = [pa.array([f"s{k}" for k in range(500)]), pa.array([0] * 500), pa.array([ops] * 500, kind), pa.array([0] * 500), pa.array([None] * 500)]
    out = list(pickles._summaries([pa.RecordBatch.from_arrays(columns, names)]))
    assert len(out) == 1 and out[0].num_rows == 500
    assert out[0].column("imports").to_pylist() == [[{"seq": 0, "module": "os", "name": "system"}]] * 500
    # A block of many opcodes is unpacked alone.
    long = pa.array([ops * pickles.WIDTH, ops], kind)
    rows = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([0, 0]), long, pa.array([0, 0]), pa.array([None, None])], names)
    assert [b.num_rows for b in pickles._summaries([rows])] == [1, 1]


def test_small_slices_leave_together():
    data = [np.arange(k, k + 2, dtype="<f4").tobytes() for k in range(300)]
    rows = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(300)]), pa.array(["F32"] * 300), pa.array(data)], ["path", "dtype", "data"])
    out = list(binary._valued([rows], ["path", "dtype"], lambda row: row["data"]))
    assert len(out) == 1 and out[0].column("values").to_pylist() == [[float(k), k + 1.0] for k in range(300)]
    cut = list(binary._valued([rows], ["path", "dtype"], lambda row: row["data"], most=100))
    assert [b.num_rows for b in cut] == [50] * 6 and [v for b in cut for v in b.column("values").to_pylist()] == out[0].column("values").to_pylist()


def _measurable(layers, buckets):
    """A batch of slices with the statistics of their layers, as ``measured`` hands them out."""
    rows = [(layer, values, float(np.mean(np.concatenate(slices))), sum(map(len, slices))) for layer, slices in layers.items() for values in slices]
    names, held, means, counts = zip(*rows)
    same = lambda x, kind: pa.array([x] * len(rows), kind)
    columns = {
        "path": same("p", pa.string()), "layer": pa.array(names), "first_pos": pa.array(range(len(rows))), "values": pa.array([v.tolist() for v in held], pa.list_(pa.float64())),
        "n": pa.array(counts), "mean": pa.array(means), "std": same(1.0, pa.float64()), "low": same(0.0, pa.float64()), "high": same(9.0, pa.float64()),
        "bins": same(0, pa.int64()), "buckets": same(buckets, pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def test_distinct_values_of_many_slices_travel_together():
    """A slice of a large layer had an array for almost each of its values, all held until the end of a batch."""
    rng = np.random.default_rng(8)
    layers = {"wide": [rng.normal(size=200) for _ in range(100)], "few": [np.array([0.0, -0.0, 1.0, 1.0] * 50) for _ in range(100)]}
    batch = _measurable(layers, 400)
    out = list(weights._measure(3.0)([batch.slice(0, 150), batch.slice(150)]))
    rows = [row for b in out for row in b.to_pylist()]
    assert sum(len(row["distinct"]) for row in rows) <= 2 * 400
    for layer, slices in layers.items():
        lists = [d for row in rows if row["layer"] == layer for d in row["distinct"]]
        assert sorted(v for d in lists for v in d["held"]) == np.unique(np.concatenate(slices) + 0.0).tolist()
        assert all(0 <= d["bucket"] < 400 for d in lists)
        far = sum(int((np.abs(v - np.mean(np.concatenate(slices))) > 3).sum()) for v in slices)
        assert sum(row["far"] for row in rows if row["layer"] == layer) == far


def test_distinct_values_held_are_bounded():
    layers = {"wide": [np.arange(k * 200, (k + 1) * 200) + 0.5 for k in range(100)], "few": [np.arange(200) % 3.0 for k in range(100)]}
    out = list(weights._measure(3.0, most=1000)([_measurable(layers, 7)]))
    held = [sum(len(d["held"]) for row in b.to_pylist() for d in row["distinct"]) for b in out]
    assert max(held) <= 2000 and sum(1 for h in held if h) >= 10
    told = {layer: {} for layer in layers}
    for row in (row for b in out for row in b.to_pylist()):
        for d in row["distinct"]:
            for v in d["held"]:
                # A value always goes to the same place.
                assert told[row["layer"]].setdefault(v, d["bucket"]) == d["bucket"]
    assert {layer: sorted(v) for layer, v in told.items()} == {layer: np.unique(np.concatenate(s)).tolist() for layer, s in layers.items()}


def test_slices_of_a_layer_go_to_several_tasks(spark):
    rows = [("p", "l", k * 50, [float(v % 3) for v in range(50)]) for k in range(400)]
    slices = spark.createDataFrame(rows, "path string, layer string, first_pos long, values array<double>")
    stats = spark.createDataFrame(weights.layer_stats(slices).collect())
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ["-1", "false"]):
            spark.conf.set(name, value)
        found = weights.measured(slices, stats)
        assert found.groupBy(F.spark_partition_id()).count().count() > 1
        assert [(r.unique_values, r.total_values) for r in weights.uniqueness(slices).collect()] == [(3, 20_000)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_statistics_of_layers_are_worked_out_once(spark):
    numbers = spark.range(3000).select(F.lit("p").alias("path"), F.lit("l").alias("layer"), F.col("id").alias("pos"), (F.col("id") % 5).cast("double").alias("value"))
    found = weights.uniqueness(weights.sliced(numbers, 50))
    assert _plan(found).count("_summed_up") == 1
    assert [(r.unique_values, r.total_values, round(r.uniqueness_ratio, 6)) for r in found.collect()] == [(5, 3000, 0.001667)]
