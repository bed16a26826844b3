"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random into ``BITS`` dimensions (its own number, if
that is more) and coded once: a bit plane of its signs, ``PLANES`` bit planes of its
rotated values in equal steps, and the correction factor f = <signs / sqrt(BITS),
rotated vector>. The product of the signs of one code with the values of another,
divided by sqrt(BITS) * f, is an unbiased estimate of the cosine; its error is
below EPSILON * sqrt((1 - f^2) / f^2 / (BITS - 1) + step^2 / 12 / f^2) but for a chance
of about 1e-9. A pair whose upper bound stays below the threshold is given up, any
other is computed exactly, in double precision. Codes are stored and travel to the
buckets; vectors travel to the groups that the codes leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.blocks import as_links, in_blocks, shared_buckets
from tamperlens.llm.common import boundaries, forest, stored, whole_runs
from tamperlens.llm.components import components

THRESHOLD = 0.95
BITS, PLANES = 256, 4
EPSILON = 6.0
MISS = 1e-6
BLOCK = 512


@lru_cache(maxsize=8)
def rotation(dim: int, out: int, seed: int) -> np.ndarray:
    """``dim`` orthonormal directions of a random rotation of max(dim, out) dimensions, as columns."""
    size = max(dim, out)
    basis, triangle = np.linalg.qr(np.random.default_rng([seed, dim, out]).normal(size=(size, dim)))
    return basis * np.sign(np.diag(triangle))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes, correction factors, and lowest value and step of the planes of unit vectors."""
    turned = unit @ rotation(unit.shape[1], BITS, 1).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([turned >= 0, *((level >> k) & 1 for k in range(PLANES))], axis=1).astype(np.uint8)
    factors = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(planes, axis=2).reshape(len(unit), -1), factors, low, step


def estimates(packed: np.ndarray, factors: np.ndarray, low: np.ndarray, step: np.ndarray, width: int) -> np.ndarray:
    """Estimates of the cosines: signs of the row's code, values of the column's."""
    bits = np.unpackbits(packed.reshape(len(packed), PLANES + 1, -1), axis=2)[:, :, :width]
    signs = bits[:, 0].astype(np.float32) * 2 - 1
    level = sum(bits[:, 1 + k].astype(np.float32) * 2**k for k in range(PLANES))
    values = low[:, None].astype(np.float32) + step[:, None].astype(np.float32) * level
    return (signs @ values.T) / (np.sqrt(width) * factors)[:, None]


def upper_bounds(packed: np.ndarray, factors: np.ndarray, low: np.ndarray, step: np.ndarray, width: int) -> np.ndarray:
    """Upper confidence bounds of the cosines; both codes of a pair serve as the row once, the lesser bound holds."""
    own = np.maximum(1 - factors**2, 0) / max(width - 1, 1)
    spread = np.sqrt(own[:, None] + step[None, :] ** 2 / 12) / factors[:, None]
    bound = estimates(packed, factors, low, step, width) + EPSILON * spread
    return np.minimum(bound, bound.T)


def _units(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Vectors scaled to length one; widths may differ between rows."""
    out = []
    for values in column.to_pylist():
        vector = np.asarray(values, np.float64)
        vector = vector / np.abs(vector).max()
        out.append(vector / np.linalg.norm(vector))
    return out


def _corner(unit: np.ndarray, seed: int) -> np.ndarray:
    """Nearest corner of a randomly rotated cross-polytope: number of the axis, twice, plus its side."""
    turned = unit @ rotation(unit.shape[1], unit.shape[1], seed).T
    axis = np.abs(turned).argmax(axis=1)
    return 2 * axis + (turned[np.arange(len(unit)), axis] > 0)


def agreement(dim: int, trials: int = 20_000) -> float:
    """Chance that two vectors at the threshold share the nearest corner, measured on drawn pairs."""
    rng = np.random.default_rng([3, dim])
    a, b = rng.normal(size=(2, trials, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-300)[:, None]
    other = THRESHOLD * a + np.sqrt(1 - THRESHOLD**2) * b
    return max(0.05, float((_corner(a, 2) == _corner(other, 2)).mean()) * 0.98)


def plan(rows: int, dim: int) -> tuple[int, int]:
    """Corners joined into a key, and number of keys: keys outnumber the rows eightfold, so that chance meetings
    stay in proportion to the rows, and a pair at the threshold misses all keys with a chance of ``MISS``."""
    joined = max(1, ceil(log(8 * max(rows, 1)) / log(2 * max(dim, 2))))
    return joined, ceil(log(MISS) / log(1 - agreement(dim) ** joined)) if dim > 1 else 1


def _coded(plans: dict[int, tuple[int, int]]):
    """Code and keys of every vector, made once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("rep").to_numpy(), _units(batch.column("vec"))
            widths = np.array([len(v) for v in vectors])
            for dim in np.unique(widths).tolist():
                at = np.flatnonzero(widths == dim)
                unit = np.stack([vectors[k] for k in at])
                joined, tables = plans[dim]
                out = np.empty((len(at), tables), np.int64)
                for t in range(tables):
                    key = np.full(len(at), dim * 4096 + t, np.int64)
                    for c in range(joined):
                        key = key * 1_000_003 + _corner(unit, 1000 + t * joined + c)
                    out[:, t] = key
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel()))
                packed, *numbers = codes(unit)
                planes = pa.array([row.tobytes() for row in packed], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), planes, *map(pa.array, numbers), lists],
                    ["rep", "dim", "code", "factor", "low", "step", "keys"],
                )

    return run


def _near(table: pa.Table, s: int, e: int) -> np.ndarray:
    """Which pairs of rows s..e can reach the threshold by their codes (equal widths, across sides)."""
    side, widths = (table.column(c).to_numpy()[s:e] for c in ("block", "dim"))
    numbers = [table.column(c).to_numpy()[s:e] for c in ("factor", "low", "step")]
    packed = table.column("code").slice(s, e - s).to_pylist()
    near = np.zeros((e - s, e - s), bool)
    for dim in np.unique(widths).tolist():
        at = np.flatnonzero(widths == dim)
        planes = np.stack([np.frombuffer(packed[k], np.uint8) for k in at])
        near[np.ix_(at, at)] = upper_bounds(planes, *(x[at] for x in numbers), max(dim, BITS)) >= THRESHOLD
    if side[0] != side[-1]:
        near &= side[:, None] != side[None, :]
    return np.triu(near, 1)


def _rough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, ["key", "i", "j"]):
        starts = boundaries(table, ["key", "i", "j"])
        ids = table.column("rep").to_numpy()
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            if e - s > 1:
                near = _near(table, s, e)
                links = forest(zip(*(x.tolist() for x in np.nonzero(near))), e - s)
                if links:
                    yield as_links(ids[s:e], links)


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, null): a forest of the links; (a, null, n): a has n links inside this pair of blocks."""
    for table in whole_runs(batches, ["key", "i", "j"]):
        starts = boundaries(table, ["key", "i", "j"])
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            if e - s < 2:
                continue
            a, b = np.nonzero(_near(table, s, e))
            if not len(a):
                continue
            vectors = _units(table.column("vec").slice(s, e - s))
            held = np.zeros(len(a), bool)
            for at in range(0, len(a), 20_000):
                part = slice(at, at + 20_000)
                left, right = (np.stack([vectors[k] for k in x[part].tolist()]) for x in (a, b))
                held[part] = np.einsum("ij,ij->i", left, right) >= THRESHOLD
            a, b = a[held], b[held]
            if not len(a):
                continue
            weight, own = np.zeros(e - s, np.int64), copies[s:e]
            np.add.at(weight, a, own[b])
            np.add.at(weight, b, own[a])
            tied = np.array(forest(zip(a.tolist(), b.tolist()), e - s), np.int64).reshape(-1, 2)
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[s:e][tied[:, 0]], ids[s:e][some]])),
                    pa.array(ids[s:e][tied[:, 1]].tolist() + [None] * len(some), pa.int64()),
                    pa.array([None] * len(tied) + weight[some].tolist(), pa.int64()),
                ],
                ["a", "b", "n"],
            )


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of equal width with a cosine of 0.95 or more are linked. Equal
    vectors are one node with a number of copies. Keys of corners of rotated
    cross-polytopes propose pairs; bounds from the codes tie what may reach the
    threshold into groups, without writing pairs; inside a group, pairs of
    bounded blocks are bounded again and what remains is computed exactly, from
    the vectors that came with the codes.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, nor do rows without an id. Repeated rows count each
    other. An empty table gives an empty table; other columns are not looked at.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")
    ).withColumn(
        "vec",
        F.when(
            F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0),
            F.col("vec"),
        ),
    )
    nodes = stored(
        rows.where("vec is not null and id is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    # One row per width of vectors: a handful.
    plans = {r[0]: plan(r[1], r[0]) for r in nodes.groupBy(F.size("vec")).count().collect()}
    kind = "rep long, dim int, code binary, factor double, low double, step double, keys array<long>"
    coded = stored(nodes.select("rep", "vec").mapInArrow(_coded(plans), kind), "codes")
    banded, light = coded.select("rep", F.explode("keys").alias("key")), coded.drop("keys")
    members = stored(shared_buckets(banded), "members").join(light, "rep")
    rough = in_blocks(members, "key", "n", BLOCK).mapInArrow(_rough, "a long, b long")
    groups = stored(components(rough), "groups").select(F.col("node").alias("rep"), F.col("component").alias("key"))
    sized = groups.join(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").join(light, "rep").join(nodes, "rep")
    found = stored(in_blocks(sized, "key", "n", BLOCK).mapInArrow(_exact, "a long, b long, n long"), "found")
    degrees = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    linked = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    named = nodes.join(degrees, "rep", "left").join(linked, "rep", "left").select(
        "vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    return rows.where("id is not null").join(named, "vec", "left").unionByName(
        rows.where("id is null").select("*", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    ).select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
