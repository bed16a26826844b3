"""Groups cut into blocks: pairs are compared inside tasks of bounded size, and only few links leave them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_buckets(banded: DataFrame) -> DataFrame:
    """(key, n, rep) of the buckets with several members, out of rows (rep, key).

    Sizes and checksums are combined before the shuffle. Bands often gather the
    same rows: of buckets with equal members (by size and two 64-bit checksums)
    one stands for all.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"f{i}") for i in range(2)]
    buckets = (
        banded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), *marks)
        .where("n > 1")
        .groupBy("n", "f0", "f1")
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )
    return banded.join(buckets, "key")


def in_blocks(members: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """Give each member of a group to every pair of blocks that its block takes part in."""
    blocks = F.ceil(F.col(n) / F.lit(size)).cast("int")
    spread = members.withColumn("_blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    )
    one = F.col("_blocks") == 1
    pairs = F.when(one, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("_blocks") - 1),
            lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
        )
    )
    out = spread.withColumn("_pair", F.explode(pairs)).withColumns({"i": F.col("_pair.i"), "j": F.col("_pair.j")})
    return (
        out.drop("_pair", "_blocks", n)
        .repartition(F.col(key), F.col("i"), F.col("j"))
        .sortWithinPartitions(key, "i", "j", "block")
    )


def run_pairs(starts: np.ndarray, ends: np.ndarray, side: np.ndarray | None, most: int = 200_000):
    """Index pairs inside runs, in pieces of bounded size; with sides, only pairs that cross them."""
    ia, ib, n = [], [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        size = e - s
        if size < 2:
            continue
        crossed = side is not None and side[s] != side[e - 1]
        if size == 2:
            a, b = np.array([0]), np.array([1])
        elif crossed:
            cut = int(np.searchsorted(side[s:e], side[e - 1]))
            a, b = np.repeat(np.arange(cut), size - cut), np.tile(np.arange(cut, size), cut)
        else:
            a, b = np.triu_indices(size, 1)
        ia.append(a + s)
        ib.append(b + s)
        n += len(a)
        if n >= most:
            yield np.concatenate(ia), np.concatenate(ib)
            ia, ib, n = [], [], 0
    if n:
        yield np.concatenate(ia), np.concatenate(ib)


def as_links(ids: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])
