"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct five-word shingles, as 64-bit digests of
lower-cased words. Banding proposes pairs; their signatures are compared in
batches, and a pair is given up as soon as the posterior probability that it
reaches the threshold (uniform prior) is below ``MISS``. What survives is
grouped, and groups are verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.blocks import as_links, in_blocks, run_pairs, shared_buckets
from tamperlens.llm.common import boundaries, forest, slices, stored, whole_runs
from tamperlens.llm.components import components

WIDTH = 5
PERCENT = 85
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-7
# Rows of a block: a group larger than this is cut into pairs of blocks.
BLOCK, EXACT_BLOCK = 512, 256
_MEMO_WORDS = 400_000
_COLUMNS = 16_384


def _odd(seed: int, n: int, kind) -> np.ndarray:
    top = np.iinfo(kind).max
    return np.random.default_rng(seed).integers(0, top, n, dtype=kind, endpoint=True) | kind(1)


_PLACES = _odd(11, WIDTH + 1, np.uint64)
_FACTORS = _odd(12, HASHES, np.uint32)
_SHIFTS = _odd(13, HASHES, np.uint32)


class _Words(dict):
    """Digest of every word seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        digest = self[word] = xxhash.xxh3_64_intdigest(word)
        return digest


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _PLACES[WIDTH]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct digests of the shingles of a text; empty without a word.

    Only A-Z are lower-cased and only the six ASCII white-space bytes separate
    words, which is what ``bytes`` methods do. Fewer than five words count as one
    shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digests = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    if n < 1:
        return _mix(np.array([(digests * _PLACES[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    total = digests[:n] * _PLACES[0]
    for k in range(1, WIDTH):
        total += digests[k : k + n] * _PLACES[k]
    return np.unique(_mix(total))


def signature(found: np.ndarray) -> bytes:
    """Low halves of the minima under all hash functions."""
    low = (found >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at : at + 1024] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2").tobytes()


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            counts, names, signs = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                counts.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())],
                ["id", "n_shingles", "set_id", "sig"],
            )


@lru_cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """Matches needed after each batch. With a uniform prior, m matches in n give
    P(similarity >= t) = P(Binomial(n + 1, t) <= m); below ``miss`` a pair is given up."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def sequential(signs: np.ndarray, a: np.ndarray, b: np.ndarray, needed: tuple[int, ...]) -> np.ndarray:
    """Positions of the pairs that no batch of signatures ruled out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(needed):
        part = slice(k * BATCH, (k + 1) * BATCH)
        left, right = signs[:, part], signs[:, part]
        for at in range(0, len(alive), 50_000):
            sub = alive[at : at + 50_000]
            matches[sub] += (left[a[sub]] == right[b[sub]]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    return alive


def _verify_signs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    needed = least_matches()
    for table in whole_runs(batches, ["key", "i", "j"]):
        starts = boundaries(table, ["key", "i", "j"])
        ends = np.append(starts[1:], table.num_rows)
        ids, side = table.column("rep").to_numpy(), table.column("block").to_numpy()
        signs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        for a, b in run_pairs(starts, ends, side):
            kept = sequential(signs, a, b, needed)
            links = forest(zip(a[kept].tolist(), b[kept].tolist()), table.num_rows)
            yield as_links(ids, links)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [shingles(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["rep", "found"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, exactly: products of 0/1 rows over slices of the union."""
    union, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, len(union), _COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + _COLUMNS])
        part = np.zeros((len(sets), min(_COLUMNS, len(union) - at)), np.float32)
        part[row[lo:hi], place[lo:hi] - at] = 1
        out += part @ part.T
    return out


def _verify_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, ["key", "i", "j"]):
        starts = boundaries(table, ["key", "i", "j"])
        ends = np.append(starts[1:], table.num_rows)
        ids, side = table.column("rep").to_numpy(), table.column("block").to_numpy()
        found = table.column("found")
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in found.slice(s, e - s).to_pylist()]
            sizes = np.array([len(x) for x in sets])
            if e - s == 2:
                common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                links = [(0, 1)] if 100 * common >= PERCENT * (sizes.sum() - common) else []
            else:
                common = overlaps(sets)
                near = 100 * common >= PERCENT * (sizes[:, None] + sizes - common)
                if side[s] != side[e - 1]:
                    near &= side[s:e, None] != side[None, s:e]
                a, b = np.nonzero(np.triu(near, 1))
                links = forest(zip(a.tolist(), b.tolist()), e - s)
            if links:
                yield as_links(ids[s:e], links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= 85 * |union| are linked. Bands of six
    hashes propose a pair of similarity 0.85 in one of 32 bands with probability
    1 - 2.6e-7 or more. Equal sets are one node. A bucket is compared by pairs of
    bounded blocks, and what leaves a block is a spanning forest, never all
    pairs; the groups so found are verified on full sets, again by blocks.

    Null, empty and white-space texts have no shingles and no link; fewer than
    five words are one shingle. Repeated rows are equal sets, so they are linked;
    a null id keeps its row, alone if nothing equals it. An empty table gives an
    empty table; other columns are not looked at.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(texts.mapInArrow(_sign, "id long, n_shingles long, set_id binary, sig binary"), "signed")
    sets = stored(
        signed.where("set_id is not null and id is not null").groupBy("set_id").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")),
        "sets",
    )
    keys = [
        F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)
    ]
    banded = sets.select("rep", F.explode(F.array(*keys)).alias("key"))
    members = stored(shared_buckets(banded), "members").join(sets.select("rep", "sig"), "rep")
    rough = in_blocks(members, "key", "n", BLOCK).mapInArrow(_verify_signs, "a long, b long")
    groups = stored(components(rough), "groups").withColumnRenamed("node", "rep").withColumnRenamed("component", "key")
    sized = groups.join(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    found = texts.join(groups.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").mapInArrow(_sets, "rep long, found binary")
    exact = in_blocks(sized.join(found, "rep"), "key", "n", EXACT_BLOCK).mapInArrow(_verify_sets, "a long, b long")
    linked = components(exact).select(F.col("node").alias("rep"), "component")
    named = sets.select("set_id", "rep").join(linked, "rep", "left").select(
        "set_id", F.coalesce("component", "rep").alias("component")
    )
    return signed.join(named, "set_id", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
