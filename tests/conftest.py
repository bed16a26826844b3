"""A Spark session and inert fixtures: marker words in names or text, nothing that runs."""

from __future__ import annotations

import json
import pickle
import struct
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from made_files import gguf_bytes, gguf_entry, import_pickle, safetensors_bytes, tar_bytes, zip_bytes  # noqa: E402

from tamperlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def model_dir(tmp_path_factory):
    """A folder of inert artifacts, one or more per detector."""
    import numpy as np

    folder = tmp_path_factory.mktemp("models")
    config = {
        "class_name": "Functional",
        "config": {"layers": [{"class_name": "Lambda", "config": {"function": "plain words"}}, {"class_name": "Dense", "module": "os", "config": {"units": 2_000_000_000}}]},
    }
    rng = np.random.default_rng(1)
    spiky = rng.normal(size=1000).astype("float32")
    spiky[:20] = 50
    files = {
        "benign.pkl": pickle.dumps({"a": 1, "b": [1, 2]}),
        "imports.pkl": import_pickle("os", "system"),
        "broken.pkl": b"plain words, no pickle",
        "empty.pth": b"",
        "torch.pt": zip_bytes({"archive/data.pkl": pickle.dumps({"w": [0.5]}), "archive/data/0": spiky.tobytes()}),
        "slip.zip": zip_bytes({"ok.txt": b"x", "../up.txt": b"x", "/abs.txt": b"x"}),
        "safe.npz": zip_bytes({"a.npy": b"x", "b.npy": b"y"}),
        "link.tar": tar_bytes([("ok.txt", b"x", None), ("ln", None, "/etc/passwd"), ("../t", b"y", None)]),
        "packed.tar.gz": tar_bytes([("../t", b"y", None)], "w:gz"),
        "lambda.keras": zip_bytes({"config.json": json.dumps(config).encode()}, packed=True),
        "badjson.keras": zip_bytes({"config.json": b"{not json"}),
        "count.gguf": gguf_bytes(tensors=2**64 - 1, entries=[gguf_entry("general.name", 8, struct.pack("<Q", 4) + b"{{x}")]),
        "template.gguf": gguf_bytes(entries=[gguf_entry("tokenizer.chat_template", 8, struct.pack("<Q", 24) + b"{{ x.__class__ }} padded.")]),
        "legacy.ggml": b"GGML" + b"\0" * 40,
        "spikes.safetensors": safetensors_bytes({"w": ("F32", spiky.tobytes())}, {"note": "100%n"}),
        "graph.pb": b"\x0a\x06PyFunc\x12\x08ReadFile",
        "looks.png": b"\x89PNG\r\n\x1a\n....IEND\xae\x42\x60\x82" + b"MZ" + b"\0" * 20,
        "wrong.onnx": b"%PDF-1.4 http://169.254.169.254/x https://cdn.example.net/file.bin",
        "pkg.whl": zip_bytes({"p.dist-info/METADATA": b"Name: p\nRequires-Dist: numpyy (>=1)\nRequires-Dist: pandas\n"}),
        "notes.txt": b'token = "abcdefgh12345678"\n',
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    model = folder / "saved"
    (model / "variables").mkdir(parents=True)
    (model / "saved_model.pb").write_bytes(b"PyFunc")
    (model / "variables" / "variables.index").write_bytes(b"x")
    return folder
