"""Exact duplicates, screened by static binary-fuse filters.

An immutable snapshot of a corpus gets one filter per shard of its digests
(three slots per key, eight-bit fingerprints, about nine bits a key). Incoming
digests that a filter denies are new for certain; those it admits are joined
with the exact buckets of the snapshot, whose bytes are compared. Duplicates
inside the new batch are grouped among themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.common import boundaries, stored, whole_runs

SHARD_KEYS = 200_000
_FILTER = "snapshot int, shard int, seed long, segment int, segments int, fingerprints binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(mixed: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of every key, in consecutive segments."""
    start = ((mixed >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (start + np.uint64(segment)) ^ ((mixed >> np.uint64(18)) & mask)
    third = (start + np.uint64(2 * segment)) ^ (mixed & mask)
    return np.stack([start, second, third], axis=1).astype(np.int64)


def _prints(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, number of start segments, fingerprints) of distinct 64-bit keys."""
    n = len(keys)
    segment = 4 if n < 2 else 1 << max(2, min(18, floor(log(n) / log(3.33) + 2.25)))
    wanted = round(n * (max(1.125, 0.875 + 0.25 * log(1e6) / log(n)) if n > 1 else 2))
    segments = max(1, ceil(wanted / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1000):
        mixed = _mix(keys, seed)
        slots = _slots(mixed, segment, segments)
        order = _peel(slots, size)
        if order is not None:
            prints, out = _prints(mixed), np.zeros(size, np.uint8)
            for who, slot in reversed(order):
                own = slots[who]
                value = prints[who]
                for k in range(3):
                    value = value ^ np.where(own[:, k] == slot, 0, out[own[:, k]]).astype(np.uint8)
                out[slot] = value
            return seed, segment, segments, out.tobytes()
    raise RuntimeError("no seed suits these keys")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, slots): each key alone in its slot once earlier rounds are gone; None if some stay."""
    counts = np.bincount(slots.ravel(), minlength=size)
    owners = np.zeros(size, np.int64)
    np.bitwise_xor.at(owners, slots.ravel(), np.repeat(np.arange(len(slots)), 3))
    order, left = [], len(slots)
    look = np.arange(size)
    while left:
        alone = look[counts[look] == 1]
        if not len(alone):
            return None
        who, first = np.unique(owners[alone], return_index=True)
        order.append((who, alone[first]))
        gone = slots[who].ravel()
        np.subtract.at(counts, gone, 1)
        np.bitwise_xor.at(owners, gone, np.repeat(who, 3))
        left -= len(who)
        look = np.unique(gone)
    return order


def admits(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    """False only for keys that are not in the filter."""
    mixed = _mix(keys, seed)
    table, slots = np.frombuffer(prints, np.uint8), _slots(mixed, segment, segments)
    return (table[slots[:, 0]] ^ table[slots[:, 1]] ^ table[slots[:, 2]]) == _prints(mixed)


def _build_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, ["snapshot", "shard"]):
        starts = boundaries(table, ["snapshot", "shard"])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            keys = np.unique(table.column("key").to_numpy()[s:e].view(np.uint64))
            made = build(keys)
            row = [table.column("snapshot")[s].as_py(), table.column("shard")[s].as_py(), *made]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            names = ["snapshot", "shard", "seed", "segment", "segments", "fingerprints"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)


def build_filters(digests: DataFrame, shards: int, snapshot: int = 0) -> DataFrame:
    """One filter per shard of a snapshot's distinct digests (columns sha, key)."""
    return (
        digests.select(F.lit(snapshot).cast("int").alias("snapshot"), _shard(shards).alias("shard"), "key")
        .repartition("snapshot", "shard")
        .sortWithinPartitions("snapshot", "shard")
        .mapInArrow(_build_shards, _FILTER)
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters come before the digests of their shard; a shard without a filter admits nothing."""
    shard = made = None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
        keep = np.zeros(len(shards), bool)
        for s, e in zip(starts, [*starts[1:], len(shards)]):
            if shards[s] != shard:
                shard, made = shards[s], []
            for k in range(s, e):
                if not batch.column("seed")[k].is_valid:
                    break
                made.append([batch.column(c)[k].as_py() for c in ("seed", "segment", "segments", "fingerprints")])
                s += 1
            keys = batch.column("key").slice(s, e - s).to_numpy(zero_copy_only=False).view(np.uint64)
            for one in made if s < e else ():
                keep[s:e] |= admits(keys, *one)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("sha", "key")], ["sha", "key"])


def screen(filters: DataFrame, digests: DataFrame, shards: int) -> DataFrame:
    """The digests (sha, key) that the filters admit: all that are in the snapshots, and about 0.4 % others."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("seed", "long"), ("segment", "int"), ("segments", "int"), ("fingerprints", "binary"))]
    rows = digests.select(_shard(shards).alias("shard"), F.lit(1).alias("kind"), "sha", "key", *empty)
    heads = filters.select(
        "shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("sha"), F.lit(0).cast("long").alias("key"),
        "seed", "segment", "segments", "fingerprints",
    )
    return heads.unionByName(rows).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_screen, "sha binary, key long")


def digested(df: DataFrame, incoming: Column, id_col: str, text_col: str) -> DataFrame:
    """(id, incoming, sha, mark, text): a digest of the bytes of a text (null: none), and a second one with the length."""
    texts = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(incoming, F.lit(False)).alias("incoming"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    mark = F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    return texts.select("id", "incoming", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), mark.alias("mark"), "text")


def exact_duplicates(
    df: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows for which ``incoming`` holds are the new batch, the others the
    snapshot. Of equal texts the row with the largest id stays. Digests are
    counted per task before any shuffle, so a hot text costs one row per task;
    texts move only if their digest occurs more than once, and the bytes under
    one digest must be one text (else the job stops, as two independent digests
    and a length would have to collide).

    A null text is an empty text. Among rows that share text and largest id,
    all count as the row that stays. A null id loses to any other, and a group
    of null ids only keeps all its rows, with a null keep_id. An empty table gives an
    empty table; other columns are not looked at.
    """
    texts = digested(df, incoming, id_col, text_col)
    flagged = stored(texts.drop("text"), "digests")
    per = stored(
        flagged.groupBy("sha", "mark", "incoming").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")), "buckets"
    ).withColumn("key", F.xxhash64("sha"))
    snapshot, batch = per.where("not incoming"), per.where("incoming")
    shards = max(1, ceil(snapshot.count() / shard_keys))
    filters = build_filters(snapshot, shards)
    admitted = screen(filters, batch.select("sha", "key"), shards)
    known = batch.join(admitted.select("sha").distinct(), "sha", "left_semi")
    # Exact buckets: admitted digests against the snapshot; everything else is grouped where it lies.
    met = snapshot.select("sha", "mark", F.col("last").alias("last0"), F.col("n").alias("n0")).join(
        known.select("sha", "mark", F.col("last").alias("last1"), F.col("n").alias("n1")), ["sha", "mark"]
    )
    across = met.select("sha", "mark", F.greatest("last0", "last1").alias("keep_id"), (F.col("n0") + F.col("n1")).alias("n"))
    within = per.where("n > 1").join(across.select("sha", "mark"), ["sha", "mark"], "left_anti")
    groups = stored(across.union(within.select("sha", "mark", F.col("last").alias("keep_id"), "n")), "groups")
    checked = (
        texts.join(groups.select("sha", "mark").hint("merge"), ["sha", "mark"], "left_semi")
        .groupBy("sha", "mark", "text")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("sha", "mark")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("rows"))
    )
    groups = groups.join(checked, ["sha", "mark"], "left").select(
        "sha",
        "mark",
        "keep_id",
        F.when((F.col("texts") == 1) & (F.col("rows") == F.col("n")), F.col("n"))
        .otherwise(F.raise_error(F.lit("different bytes under one digest")).cast("long"))
        .alias("n"),
    )
    out = flagged.join(groups, ["sha", "mark"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
