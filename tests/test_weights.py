"""Statistics of slices against numpy over whole layers, and storages read by their named formats."""

from __future__ import annotations

import io
import pickle
import struct
import zipfile

import numpy as np
import pytest

from tamperlens.operators import weights
from tamperlens.sources import binary

SHAPE = "path string, layer string, first_pos long, values array<double>"


def cut(layers, size):
    return [(p, layer, k, values[k : k + size].tolist()) for (p, layer), values in layers.items() for k in range(0, len(values), size)]


@pytest.fixture(scope="module")
def layers():
    rng = np.random.default_rng(9)
    return {
        ("a", "normal"): rng.normal(5, 2, 3000), ("a", "far"): np.append(rng.normal(size=2900), [90.0] * 60),
        ("a", "flat"): np.full(500, 2.5), ("b", "few"): rng.integers(0, 7, 4000).astype(float), ("b", "steps"): np.arange(2500) * 0.5,
        ("b", "short"): np.array([1.0, 2.0]), ("b", "zeros"): np.array([0.0, -0.0] * 700), ("c", "large"): 1e9 + rng.normal(size=1500),
    }


@pytest.mark.parametrize("size", [64, 700, 10_000])
def test_layers_in_slices(spark, layers, size):
    slices = spark.createDataFrame(cut(layers, size), SHAPE).repartition(5)
    stats = {(r.path, r.layer): r for r in weights.layer_stats(slices).collect()}
    for key, values in layers.items():
        r, steps = stats[key], np.diff(values)
        assert (r.n, r.low, r.high, r.steps) == (len(values), values.min(), values.max(), len(steps))
        assert np.allclose([r.mean, r.std, r.diff_std], [values.mean(), values.std(), steps.std()], rtol=1e-9, atol=1e-7)
    far = {r.layer: (r.outlier_count, r.max_zscore) for r in weights.outliers(slices).collect()}
    z = np.abs((layers["a", "far"] - layers["a", "far"].mean()) / layers["a", "far"].std())
    assert set(far) == {"far"} and far["far"][0] == (z > 3).sum() and np.isclose(far["far"][1], z.max())
    assert {(r.layer, r.unique_values, r.total_values) for r in weights.uniqueness(slices).collect()} == {("few", 7, 4000), ("zeros", 1, 1400)}
    assert {r.layer: r.steps for r in weights.constant_step(slices).collect()} == {"flat": 499, "steps": 2499, "zeros": 1399}
    found = {r.layer: (r.entropy, r.issue) for r in weights.entropy(slices).collect()}
    share = np.histogram(layers["a", "far"], 100)[0] / len(layers["a", "far"])
    share = share[share > 0]
    assert set(found) == {"flat", "zeros", "far", "few"} and np.isclose(found["far"][0], -(share * np.log2(share)).sum() / np.log2(100))
    kinds = {(r.layer, r.type) for r in weights.anomalies(slices).collect()}
    assert kinds == {("far", "outlier_weights"), ("far", "low_entropy"), ("flat", "unusual_pattern"), ("flat", "low_entropy"), ("few", "unusual_pattern"), ("few", "low_entropy"), ("steps", "unusual_pattern"), ("zeros", "unusual_pattern"), ("zeros", "low_entropy")}


def test_descriptions_are_shuffled_instead_of_numbers(spark, layers, tmp_path):
    data = layers["a", "far"].astype("<f4")
    (tmp_path / "w.bin").write_bytes(b"12345678" + data.tobytes())
    rows = [(str(tmp_path / "w.bin"), "w", "F32", k, 8 + 4 * k, 4 * min(500, len(data) - k)) for k in range(0, len(data), 500)]
    described = spark.createDataFrame(rows, "path string, layer string, dtype string, first_pos long, begin long, size long")
    got = weights.outliers(described, load=binary.read_slices).collect()
    z = np.abs((data - data.astype(float).mean()) / data.astype(float).std())
    assert [r.outlier_count for r in got] == [(z > 3).sum()]


class _Storage:
    """Pickles to the persistent id of a stored tensor."""

    def __init__(self, kind, key, size):
        self.id = ("storage", kind, key, "cpu", size)


def _model(storages):
    class Writer(pickle._Pickler):
        def persistent_id(self, thing):
            return thing.id if isinstance(thing, _Storage) else None

        def save_global(self, thing, name=None):
            self.write(b"ctorch\n" + thing.__name__.encode() + b"\n")
            self.memoize(thing)

        dispatch = {**pickle._Pickler.dispatch, type: save_global}

    out = io.BytesIO()
    Writer(out, protocol=2).dump({f"layer{k}": s for k, s in enumerate(storages)})
    return out.getvalue()


def test_storages_have_the_formats_their_pickle_names(spark):
    rng = np.random.default_rng(4)
    kinds = {n: type(n, (), {}) for n in ("FloatStorage", "HalfStorage", "BFloat16Storage", "LongStorage")}
    half, single = rng.normal(size=700_000).astype("<f2"), rng.normal(size=400_000).astype("<f4")
    brain = (single[:1000].view("<u4") >> 16).astype("<u2")
    held = [("0", "FloatStorage", single.tobytes()), ("1", "HalfStorage", half.tobytes()), ("2", "BFloat16Storage", brain.tobytes()), ("3", "LongStorage", struct.pack("<4q", 1, 2, 3, 4)), ("4", "FloatStorage", single[:9].tobytes())]
    model = _model([_Storage(kinds[kind], key, 1) for key, kind, _ in held])
    rows = [("m.pt", "archive/data.pkl", model)] + [("m.pt", f"archive/data/{key}", data) for key, _, data in held] + [("n.pt", "x/data/0", single[:5].tobytes())]
    contents = spark.createDataFrame([(*r, None) for r in rows], "path string, entry string, content binary, error string")
    named = {(r.entry, r.storage) for r in binary.storage_classes(contents).collect()}
    assert named == {(f"archive/data/{key}", kind) for key, kind, _ in held}
    got: dict = {}
    for r in sorted(binary.pytorch_slices(contents).where("layer not like '%.pkl'").collect(), key=lambda r: r.first_pos):
        got.setdefault((r.path, r.layer), []).extend(r["values"])
    want = {("m.pt", "archive/data/0"): single, ("m.pt", "archive/data/1"): half.astype("f4"), ("m.pt", "archive/data/2"): (brain.astype("<u4") << 16).view("<f4"), ("m.pt", "archive/data/4"): single[:9], ("n.pt", "x/data/0"): single[:5]}
    assert set(got) == set(want)
    assert all(np.array_equal(np.array(got[k], "f4"), want[k]) for k in want)
