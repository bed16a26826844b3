"""Bytes of small inert files: marker words in names or text, nothing that runs."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile


def zip_bytes(entries: dict[str, bytes], modes: dict[str, int] | None = None, packed: bool = False) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as archive:
        for name, data in entries.items():
            info = zipfile.ZipInfo(name)
            info.external_attr = (modes or {}).get(name, 0o100644) << 16
            info.compress_type = zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED
            archive.writestr(info, data)
    return buffer.getvalue()


def tar_bytes(members: list[tuple[str, bytes | None, str | None]], mode: str = "w") -> bytes:
    """Members as (name, data, link target)."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as archive:
        for name, data, target in members:
            info = tarfile.TarInfo(name)
            if target is not None:
                info.type, info.linkname = tarfile.SYMTYPE, target
                archive.addfile(info)
            else:
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


def import_pickle(module: str, name: str) -> bytes:
    """Names an import and drops it; loading it would call nothing."""
    return b"\x80\x02c" + module.encode() + b"\n" + name.encode() + b"\n0N."


def gguf_bytes(version: int = 3, tensors: int = 0, entries: list[bytes] | None = None, rest: bytes = b"") -> bytes:
    entries = entries or []
    return b"GGUF" + struct.pack("<IQQ", version, tensors, len(entries)) + b"".join(entries) + rest


def gguf_entry(key: str, kind: int, value: bytes) -> bytes:
    return struct.pack("<Q", len(key)) + key.encode() + struct.pack("<I", kind) + value


def safetensors_bytes(tensors: dict[str, tuple[str, bytes]], metadata: dict | None = None) -> bytes:
    header, at, body = {}, 0, b""
    if metadata:
        header["__metadata__"] = metadata
    for name, (dtype, data) in tensors.items():
        header[name] = {"dtype": dtype, "shape": [len(data)], "data_offsets": [at, at + len(data)]}
        at, body = at + len(data), body + data
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + body
