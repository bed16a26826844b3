"""Byte-level BPE in Spark expressions: a fold of ranked merges over the bytes of distinct words.

Tasks cut texts into words and number the distinct ones, which go on once per
task, as arrays of byte ids with the ranks of their pairs. A higher-order fold
merges each distinct word: it takes the leftmost pair of least rank and renews
the two ranks beside it, until none is left. The ids of a document are those of
its words, and decoding joins the bytes of its ids.

The literal map is two literal arrays: rows of a sparse table laid over each
other, and where each row begins. A look-up reads one element of each, where a
map column of this size would be searched from end to end.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.common import slices
from tamperlens.llm.packing import chunks

NONE = 2**31 - 1
# Bytes of text per slice, and distinct words that a task remembers.
SLICE, KNOWN = 4_000_000, 400_000
# A word longer than this is merged with a heap: a fold takes time with the square of its length.
LONG = 512
_RANK = 2**17
# The rank in front of an element without a pair to merge, and an id beside a word. In states and the table, ids and
# ranks count from 1, so that an empty place of the table is 0 (plans spell literals out).
_NONE, _SIDE = (_RANK - 1) << 27, 65_535


@lru_cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache
def pair_ranks(path: str) -> dict[tuple[int, int], int]:
    """Rank of every two ids whose bytes together are a token."""
    known = ranks(path)
    out = {}
    for token, rank in known.items():
        for k in range(1, len(token)):
            a, b = known.get(token[:k]), known.get(token[k:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


@lru_cache
def rank_table(path: str) -> tuple[str, str]:
    """The literal map as two texts of numbers: rows of a sparse table laid over each other. The pair (a, b) lies at
    place b of the row of a, which begins at the a-th offset; an entry is a * 2^44 + rank * 2^27, an empty place 0.
    Ids and ranks count from 1."""
    rows: dict[int, list[int]] = {}
    for a, b in pair_ranks(path):
        rows.setdefault(a + 1, []).append(b + 1)
    free = np.ones(_SIDE + 1 + 3 * len(pair_ranks(path)), bool)
    table, draw = np.zeros(len(free) + _SIDE + 1, np.int64), np.random.default_rng(0)
    offsets = np.zeros(_SIDE + 1, np.int64)
    for a in sorted(rows, key=lambda k: (-len(rows[k]), k)):
        places = np.array(rows[a])
        tries = 16
        while True:
            found = draw.integers(0, len(free) - places.max(), tries)
            for b in places:
                found = found[free[found + b]]
                if not len(found):
                    break
            if len(found):
                break
            tries = min(4 * tries, 2**20)
        offsets[a] = found[0]
        free[found[0] + places] = False
        table[found[0] + places] = [(a << 44) + (pair_ranks(path)[a - 1, b - 1] + 1 << 27) for b in rows[a]]
    return ",".join(map(str, offsets)), ",".join(map(str, table))


@lru_cache
def byte_ranks(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of single bytes, and for each two bytes the rank of their pair, from 1 (``_RANK - 1``: none)."""
    known = ranks(path)
    single = np.array([known[bytes([k])] for k in range(256)], np.int64)
    pairs = [[known.get(bytes([a, b]), _RANK - 2) + 1 for b in range(256)] for a in range(256)]
    return single, np.array(pairs, np.int64)


def heap_merge(ids: list[int], known: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for one long word, least rank first and leftmost among equals, by a heap."""
    ids, right, left = list(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    end = len(ids)
    heap = [(r, k) for k in range(end - 1) if (r := known.get((ids[k], ids[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        after = right[k]
        if ids[k] < 0 or after >= end or known.get((ids[k], ids[after])) != rank:
            continue
        ids[k], ids[after] = rank, -1
        right[k] = right[after]
        if right[k] < end:
            left[right[k]] = k
        for at in (left[k], k):
            if at >= 0 and right[at] < end and (r := known.get((ids[at], ids[right[at]]))) is not None:
                heapq.heappush(heap, (r, at))
    return [x for x in ids if x >= 0]


class _Words:
    """Numbers the distinct words that a task has met; each is handed on once, as its bytes or, where it needs no fold, its ids.

    ``number`` gives the words that are new and, per text, the numbers of all its
    words. When ``KNOWN`` words are exceeded it starts again, and says so.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.known, self.find = path, ranks(path), regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.split: dict[str, list[int]] = {}

    def start(self, word: str) -> bytes | list[int]:
        data = word.encode("utf-8", "replace")
        if (whole := self.known.get(data)) is not None:
            return [whole]
        if len(data) <= LONG:
            return data
        return heap_merge(byte_ranks(self.path)[0][list(data)].tolist(), pair_ranks(self.path))

    def number(self, texts: list[str]) -> tuple[bool, list[bytes | list[int]], list[np.ndarray]]:
        again = len(self.words) > KNOWN
        if again:
            self.words.clear()
            self.split.clear()
        words, split, new, rows = self.words, self.split, [], []
        for text in texts:
            row: list[int] = []
            for chunk in chunks(text):
                found = split.get(chunk)
                if found is None:
                    found = split[chunk] = []
                    for w in self.find(chunk):
                        at = words.get(w)
                        if at is None:
                            at = words[w] = len(words)
                            new.append(self.start(w))
                        found.append(at)
                row += found
            rows.append(np.array(row, np.int32))
        return again, new, rows


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate([np.asarray(v, np.int32) for v in values]) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _states(words: list[bytes | list[int]], path: str) -> pa.ListArray:
    """First states of the fold: an element for each byte, or for each final id, and one that stands on either side."""
    single, pairs = byte_ranks(path)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.full(ends[-1], _NONE + _SIDE, np.int64)
    raw = np.fromiter((isinstance(w, bytes) for w in words), bool, len(words))
    data = np.frombuffer(b"".join(w for w in words if isinstance(w, bytes)), np.uint8)
    if len(data):
        last = np.cumsum(sizes[raw]) - 1
        rank = pairs[data, np.append(data[1:], 0)]
        rank[last] = _RANK - 1
        place = np.arange(len(data)) - np.repeat(last + 1 - sizes[raw], sizes[raw])
        out[np.repeat(ends[:-1][raw] + 1, sizes[raw]) + place] = (rank << 27) + (place << 17) + single[data] + 1
    for at in np.flatnonzero(~raw):
        out[ends[at] + 1 : ends[at + 1] - 1] = _NONE + 1 + np.array(words[at], np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _number(path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Words(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                again, words, rows = maker.number([x or "" for x in batch.column("text").to_pylist()])
                docs = pa.StructArray.from_arrays([batch.column("doc_id"), _lists(rows, pa.int32())], ["doc_id", "at"])
                columns = [pa.array([again]), _one(_states(words, path)), _one(docs)]
                yield pa.RecordBatch.from_arrays(columns, ["again", "words", "docs"])

    return run


def _spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of documents out of the numbers of their words, with the folded words of the task so far."""
    flat, starts, sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("again")[k].as_py():
                flat, starts, sizes = flat[:0], starts[:0], sizes[:0]
            words, docs = batch.column("words")[k].values, batch.column("docs")[k].values
            more = np.diff(words.offsets.to_numpy()).astype(np.int64)
            # The first and the last element of a state only stand beside the word.
            starts = np.concatenate([starts, len(flat) + np.cumsum(more) - more + 1])
            sizes = np.concatenate([sizes, more - 2])
            flat = np.concatenate([flat, ((words.flatten().to_numpy() & (_RANK - 1)) - 1).astype(np.int32)])
            named, at = docs.field("doc_id"), docs.field("at")
            for lo in range(0, len(docs), 500):
                some = at.slice(lo, 500)
                numbers = some.flatten().to_numpy()
                counts = np.diff(some.offsets.to_numpy())
                long = sizes[numbers]
                ends = np.concatenate([[0], np.cumsum(long)])
                ids = flat[np.repeat(starts[numbers] - ends[:-1], long) + np.arange(ends[-1])]
                offsets = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([named.slice(lo, 500), lists], ["doc_id", "ids"])


def fold(word: Column, path: str) -> Column:
    """The last state of a word out of its first one, for words of at most ``LONG`` bytes.

    An element of the state is a number: rank of the pair that starts here, then
    the place of its first byte (10 bits), then its id (17 bits). The least
    element is the pair to merge, leftmost among equal ranks. The first and the
    last element stand beside the word and never merge.
    """
    offsets, table = (F.split(F.lit(x), ",").cast("array<bigint>") for x in rank_table(path))
    low, none = F.lit(_RANK - 1).cast("long"), F.lit(_NONE).cast("long")

    def ranked(a: Column, b: Column) -> Column:
        """Rank of two ids, at its place in an element. What is found of another row differs from 2^44 on: more than none."""
        return table[offsets[a] + b].bitwiseXOR(F.shiftleft(a, 44))

    def step(state: Column, _: Column) -> Column:
        # A fold over one value gives it a name, so that it is computed once.
        def some(state: Column, least: Column) -> Column:
            new = F.shiftright(least, 27)

            def merge(state: Column, before: Column) -> Column:
                own = ranked(new, state[before + 3].bitwiseAND(low)).bitwiseOR(least.bitwiseAND(F.lit(1023 << 17))).bitwiseOR(new)

                def renew(e: Column, k: Column) -> Column:
                    first = ranked(e.bitwiseAND(low), new).bitwiseOR(e.bitwiseAND(F.lit(2**27 - 1)))
                    return F.when(e == least, own).when(k == before, first).otherwise(e)

                return F.array_remove(F.transform(state, renew), state[before + 2])

            before = F.array_position(state, least).cast("int") - 2
            return F.when(least >= none, state).otherwise(F.aggregate(F.array(before), state, merge))

        return F.aggregate(F.array(F.array_min(state)), state, some)

    return F.aggregate(F.slice(word, F.lit(4), F.lit(LONG)), word, step)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): one row per input row, without special tokens.

    ``path`` is a rank file that executors can read, ``pattern`` cuts a text into
    words. A null or empty text has no ids; repeated rows and null ids are kept;
    an empty table gives an empty table; other columns are not looked at. A slice
    of texts is handled inside one task, so nothing is shuffled.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "again boolean, words array<array<bigint>>, docs array<struct<doc_id: long, at: array<int>>>"
    folded = texts.mapInArrow(_number(path, pattern), kind).select(
        "again",
        F.transform("words", lambda w: F.when((F.size(w) < 4) | (F.size(w) > LONG + 2), w).otherwise(fold(w, path))).alias("words"),
        "docs",
    )
    return folded.mapInArrow(_spell, "doc_id long, ids array<int>")


def decode(ids: Column, path: str) -> Column:
    """Bytes of an array of ids: the pieces of the ids, joined."""
    pieces = sorted(ranks(path).items(), key=lambda x: x[1])
    table = F.split(F.lit(",".join(token.hex() for token, _ in pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda k: F.get(table, k)), ""))


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids in decimal, digest of the decoded bytes."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(df, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
