"""Helpers of the training-data operators: shared tables, bounded slices of Arrow batches, whole runs of a key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Characters handled at once inside a task; a longer text makes a slice of its own.
SLICE_CHARS = 2_000_000

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tamperlens-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs start from files, whoever is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the bytes of ``column`` stay near ``limit`` per piece (one row at least)."""
    data = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
    at = 0
    ends = np.cumsum(lengths)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def boundaries(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new run of equal (non-null, integer) keys starts."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs out of a stream sorted by ``keys``; only the last run is ever held back."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held:
            first = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            same = first == [table.column(k)[0].as_py() for k in keys]
            starts = boundaries(table, keys)
            if same and len(starts) == 1:
                held.append(table)
                continue
            cut = int(starts[1]) if same else 0
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held, table = [], table.slice(cut)
        last = int(boundaries(table, keys)[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held = [table.slice(last)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def forest(pairs: Iterable[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """A spanning forest of some pairs among ``size`` rows: as many links as needed to connect them alike."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept
