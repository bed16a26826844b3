"""Best-fit packing of token sequences with matching of large items.

Documents are tokenised inside tasks; what is kept of a piece is its length and
checksum. Packing needs only how many pieces have each length: at most
``capacity`` numbers, whatever the corpus. The plan made from them is a list of
segments (length, ranks, bins, offsets), also bounded by the capacity, and each
piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamperlens.llm.common import slices, stored

CAPACITY = 2048
END = 0
# Fixed value: how the byte-level pre-tokenizer of such files cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SAFE = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


def between(text: str) -> list[str]:
    """Cut a text at every blank and before every line feed that stands between two non-blanks.

    There a match of the tokenizers' pattern always begins. The blanks are left
    out: all parts but the first follow one, unless they begin with a line feed.
    """
    if text.replace("\n", " ").split(" ") == text.split():
        return text.replace("\n", " \n").split(" ")
    return _SAFE.split(text)


def chunks(text: str) -> list[str]:
    """The parts of a text with the blanks that begin them."""
    if not text:
        return []
    parts = between(text)
    return [parts[0], *(x if x[0] == "\n" else " " + x for x in parts[1:])]


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, as the tokenizer of a file gives them.

    Where the ids of a byte-level file follow its merges, a text of Latin letters
    without added tokens is merged by rank, many times faster and with the same
    ids; every other text goes through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = _ranked_encoding(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([r"[^\x00-\u024f]", *map(re.escape, added)]))

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            plain = [False] * len(texts)
        else:
            plain = [self.other.search(x) is None for x in texts]
        rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(texts, plain) if not p], add_special_tokens=False))
        found = (self.ranked.encode_ordinary(x) if p else next(rest).ids for x, p in zip(texts, plain))
        return [np.array(x, "<u4").tobytes() for x in found]


def _ranked_encoding(path: str):
    """The vocabulary as ranks, if the file is a plain byte-level one whose ids are the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or whole.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [model["vocab"].get(a + b) for a, b in pairs]
    if None in order or order != sorted(set(order)) or len(pairs) + 256 > len(model["vocab"]):
        return None
    singles = {c: model["vocab"].get(c) for c in byte}
    if None in singles.values() or max(singles.values()) >= min(order, default=2**31):
        return None
    ranks = {bytes(byte[c] for c in token): n for token, n in [*singles.items(), *((a + b, n) for (a, b), n in zip(pairs, order))]}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences at the end, the rest first."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _tokenise(path: str, capacity: int, end: int):
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = memo.ids([x or "" for x in batch.column("text").to_pylist()])
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), found):
                    ids += mark
                    for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
                        rows.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, ranks, first bin, pieces per bin, offset) that place every piece.

    Lengths above a third of the capacity are taken from the largest down; each
    is matched with the largest other such length that still fits beside it, so
    a bin holds two of them at most. Smaller lengths, largest first, go where the
    least room remains. Bins with equal contents are handled at once, which
    changes nothing in the outcome of taking pieces one by one.
    """
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    segments, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def place(n: int, many: int, start: int, per: int, offset: int) -> None:
        segments.append((n, taken[n], many, start, per, offset))
        taken[n] += many
        left[n] -= many

    def open_gap(room: int, start: int, many: int) -> None:
        if room and many:
            if room not in gaps:
                gaps[room] = []
                insort(order, room)
            gaps[room].append((start, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        # The largest length that fits beside n and is still there.
        k = bisect_left(large, capacity - n + 1) - 1
        while k >= 0 and (not left[large[k]] or (large[k] == n and left[n] < 2)):
            k -= 1
        other = large[k] if k >= 0 else None
        if other is None:
            many = left[n]
            place(n, many, bins, 1, 0)
            open_gap(capacity - n, bins, many)
        elif other == n:
            many = left[n] // 2
            place(n, 2 * many, bins, 2, 0)
            open_gap(capacity - 2 * n, bins, many)
        else:
            many = min(left[n], left[other])
            place(n, many, bins, 1, 0)
            place(other, many, bins, 1, n)
            open_gap(capacity - n - other, bins, many)
        bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k == len(order):
                per = capacity // n
                many = -(-left[n] // per)
                gaps[capacity] = [(bins, many)]
                insort(order, capacity)
                bins += many
                continue
            room = order[k]
            start, many = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                order.pop(k)
            per = room // n
            full, rest = divmod(min(left[n], many * per), per)
            if full:
                place(n, full * per, start, per, capacity - room)
                open_gap(room - per * n, start, full)
            if rest:
                place(n, rest, start + full, rest, capacity - room)
                open_gap(room - rest * n, start + full, 1)
                full += 1
            open_gap(room, start + full, many - full)
    return segments


def _placed(segments: list[tuple[int, ...]]):
    """Look every piece up in the plan: by length and rank, in sorted order."""
    plan = np.array(sorted(segments), np.int64).reshape(-1, 6)
    keys = plan[:, 0] * 2**50 + plan[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length * 2**50 + rank, side="right") - 1]
            step = rank - row[:, 1]
            where = [row[:, 3] + step // row[:, 4], row[:, 5] + step % row[:, 4] * length]
            columns = [*batch.columns[:5], *map(pa.array, where)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def _ranked(pieces: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, among the pieces of equal length, without sorting a length in one task.

    Rows are counted per block and length; only those counts are summed up in
    a window per length. A block is a stable, bounded share of the rows.
    """
    blocks = stored(pieces.withColumn("_block", F.spark_partition_id()), "pieces")
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = blocks.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["length", "_block"]).select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("rank"))


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one ``end``; only longer ones than ``capacity`` are
    cut, the first piece taking the remainder. ``tokenizer`` is the path of a
    tokenizer file that every executor can read.

    A null or empty text is the single ``end``. Repeated rows are documents of
    their own; a null id is kept. An empty table gives an empty table; other
    columns are not looked at. Pieces of equal length and rank order are placed
    by id, so ties fall the same way for the same blocks of input.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(_ranked(texts.mapInArrow(_tokenise(tokenizer, capacity, end), _PIECE)), "ranked")
    # At most one row per length up to the capacity reaches the driver.
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    segments = pack_lengths(counts, capacity)
    return pieces.mapInArrow(_placed(segments), f"{_PIECE}, sequence_id long, offset long")
