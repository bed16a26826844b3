"""Ranked lexical search by pipelined term partitioning.

Items travel in bundles. A bundle visits the owners of its terms one after
another and carries sparse accumulators (document, score) along; each owner adds
the integer contributions of its postings by a cogroup. Documents are cut into
bounded blocks, and a bundle carries one set of accumulators per block, so no
group grows with the corpus. Owners hold terms by falling weight: the first
stages settle most, and what can no longer reach the block's first places,
whatever the later owners add, is left behind. That bound is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamperlens.llm.common import stored

TOP = 10
OWNERS = 4
# Items of a bundle, and bytes of items that are looked for in one reading of the documents.
BUNDLE, ROUND_BYTES = 256, 16_000_000
# Documents and bytes of text in a block.
BLOCK_DOCS, BLOCK_BYTES = 512, 2_000_000
_PART = 1_000_000
# No posting adds more than its term's weight times this.
_MOST = 1_000_000
_LAST = 2**63 - 1

# Letters and digits of ASCII, in lower case, and every byte of other characters; the rest separates.
_TABLE = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or 48 <= k <= 57 or 97 <= k <= 122 else 32 for k in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, those of a long one in parts."""
    plain = data.translate(_TABLE)
    at = 0
    while at < len(plain):
        stop = len(plain) if len(plain) - at <= _PART else plain.rfind(b" ", at, at + _PART) + 1
        if stop <= at:
            stop = plain.find(b" ", at + _PART) + 1 or len(plain)
        yield plain[at:stop].split()
        at = stop


@dataclass
class Bundle:
    """Items that travel together: their ids, and (term, item, how often) sorted by term."""

    ids: list[int | None]
    term: np.ndarray
    item: np.ndarray
    often: np.ndarray

    def owned(self, terms_of_owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = terms_of_owner[self.term]
        return self.term[mine], self.item[mine], self.often[mine]


def bundles_of(rows: list[tuple[int | None, str | None]], size: int) -> tuple[dict[bytes, int], list[Bundle]]:
    """Numbers of all terms, and the items in bundles of ``size``, in order."""
    numbers: dict[bytes, int] = {}
    out = []
    for at in range(0, len(rows), size):
        some = rows[at : at + size]
        found: dict[tuple[int, int], int] = {}
        for k, (_, text) in enumerate(some):
            for part in terms((text or "").encode("utf-8", "replace")):
                for w in part:
                    key = numbers.setdefault(w, len(numbers)), k
                    found[key] = found.get(key, 0) + 1
        table = np.array([(*key, n) for key, n in sorted(found.items())], np.int64).reshape(-1, 3)
        out.append(Bundle([i for i, _ in some], table[:, 0], table[:, 1], table[:, 2]))
    return numbers, out


_BLOCK = "block long, ids array<long>, sizes array<long>, at array<int>, term array<int>, tf array<long>, filled long, words long"


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _index(vocabulary):
    """Blocks of documents: ids and sizes, and the postings of known terms."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_buffer()
                data = b"" if text is None else text.to_pybytes()
                ids.append(batch.column("doc_id")[k].as_py())
                texts.append(data)
                size += len(data)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        width = max(len(known), 1)
        base = TaskContext.get().partitionId() << 32
        for number, (ids, texts) in enumerate(blocks(pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary())], ["doc_id", "text"]) for b in batches)):
            sizes, keys = [], []
            for doc, data in enumerate(texts):
                n = 0
                for part in terms(data):
                    n += len(part)
                    found = np.array([known.get(w, -1) for w in part], np.int64)
                    keys.append(doc * width + found[found >= 0])
                sizes.append(n)
            key, tf = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_counts=True)
            columns = [
                pa.array([base + number], pa.int64()), _lists([ids], pa.int64()), _lists([sizes], pa.int64()),
                _lists([(key // width).astype(np.int32)], pa.int32()), _lists([(key % width).astype(np.int32)], pa.int32()),
                _lists([tf.astype(np.int64)], pa.int64()), pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "at", "term", "tf", "filled", "words"])

    return run


def _document_frequencies(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("term").flatten().to_numpy(), minlength=width)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    return run


@dataclass
class Plan:
    """What all stages know: corpus totals, term weights, the owner of each term (-1: weighs nothing) and the bundles."""

    docs: int
    words: int
    weights: np.ndarray
    owner: np.ndarray
    bundles: list[Bundle]
    owners: int
    top: int

    def most_after(self, stage: int, bundle: Bundle) -> np.ndarray:
        """Per item, a bound on what owners after ``stage`` can add to one document."""
        later = self.owner[bundle.term] > stage
        out = np.zeros(len(bundle.ids), np.int64)
        np.add.at(out, bundle.item[later], self.weights[bundle.term[later]] * bundle.often[later] * _MOST)
        return out


def plan_of(docs: int, words: int, df: np.ndarray, bundles: list[Bundle], owners: int, top: int) -> Plan:
    """Weights, and owners of the terms by falling weight, with alike numbers of postings."""
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    owner = np.full(len(df), -1, np.int64)
    used = np.flatnonzero(weights > 0)
    order = used[np.lexsort((used, -weights[used]))]
    before = np.cumsum(df[order]) - df[order]
    owner[order] = np.minimum(before * owners // max(int(df[order].sum()), 1), owners - 1)
    return Plan(docs, words, weights, owner, bundles, owners, top)


_POSTINGS = "block long, bundle int, at array<int>, term array<int>, gain array<long>"


def _owned(plan, stage: int):
    """The owner's postings of a block, for each bundle that asks for one of its terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        asked = []
        for b in own.bundles:
            mask = np.zeros(len(own.weights), bool)
            mask[b.term] = True
            asked.append(mask & (own.owner == stage))
        for batch in batches:
            for k in range(batch.num_rows):
                term, at, tf = (batch.column(c)[k].values.to_numpy() for c in ("term", "at", "tf"))
                mine = own.owner[term] == stage if len(term) else np.zeros(0, bool)
                if not mine.any():
                    continue
                term, at, tf = term[mine], at[mine], tf[mine]
                n = batch.column("sizes")[k].values.to_numpy()[at]
                m = 25 + 75 * n * own.docs // own.words
                gain = own.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                for bundle, mask in enumerate(asked):
                    here = mask[term]
                    if here.any():
                        columns = [pa.array([batch.column("block")[k].as_py()], pa.int64()), pa.array([bundle], pa.int32()), _lists([at[here]], pa.int32()), _lists([term[here]], pa.int32()), _lists([gain[here]], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["block", "bundle", "at", "term", "gain"])

    return run


# open: items that documents without an accumulator can still enter.
_CARRIED = "block long, bundle int, ids array<long>, item array<int>, doc array<int>, score array<long>, open array<int>"
_KINDS = pa.schema([
    ("block", pa.int64()), ("bundle", pa.int32()), ("ids", pa.list_(pa.int64())), ("item", pa.list_(pa.int32())),
    ("doc", pa.list_(pa.int32())), ("score", pa.list_(pa.int64())), ("open", pa.list_(pa.int32())),
])


def visit(plan: Plan, stage: int, bundle: Bundle, ids: np.ndarray, carried: tuple, postings: tuple) -> tuple:
    """Add an owner's gains to a bundle's accumulators over one block, and keep those that can still win."""
    item, doc, score, still_open = carried
    total = np.zeros((len(bundle.ids), len(ids)), np.int64)
    listed = np.zeros(total.shape, bool)
    total[item, doc] = score
    listed[item, doc] = True
    open_items = np.zeros(len(bundle.ids), bool)
    open_items[still_open] = True
    at, term, gain = postings
    if len(term):
        order = np.argsort(term, kind="stable")
        at, term, gain = at[order], term[order], gain[order]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        lows, highs = (np.searchsorted(bundle.term, term[starts], side) for side in ("left", "right"))
        for s, e, lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(term)], lows.tolist(), highs.tolist()):
            total[bundle.item[lo:hi, None], at[None, s:e]] += bundle.often[lo:hi, None] * gain[None, s:e]
    alive = (total > 0) & (listed | open_items[:, None])
    more = plan.most_after(stage, bundle)
    if len(ids) >= plan.top:
        counted = np.where(alive, total, 0)
        least = np.partition(counted, len(ids) - plan.top, axis=1)[:, len(ids) - plan.top]
        alive &= total + more[:, None] >= least[:, None]
        open_items &= more >= least
    open_items &= more > 0
    item, doc = np.nonzero(alive)
    return item, doc, total[item, doc], np.flatnonzero(open_items)


def _stage(plan, stage: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = plan.value
        if not left.num_rows:
            return _KINDS.empty_table()
        get = lambda table, name: table.column(name)[0].values.to_numpy(zero_copy_only=False)
        number = left.column("bundle")[0].as_py()
        ids = left.column("ids")[0].values
        postings = tuple(get(right, c) for c in ("at", "term", "gain")) if right.num_rows else ((), (), ())
        carried = tuple(get(left, c) for c in ("item", "doc", "score", "open"))
        item, doc, score, still_open = visit(own, stage, own.bundles[number], ids, carried, postings)
        columns = [left.column("block"), left.column("bundle"), left.column("ids")]
        lists = [_lists([v.astype(kind)], t) for v, kind, t in ((item, "i4", pa.int32()), (doc, "i4", pa.int32()), (score, "i8", pa.int64()), (still_open, "i4", pa.int32()))]
        return pa.Table.from_arrays([*columns, *lists], schema=_KINDS)

    return run


def _ranked_in_block(plan):
    """(item number, item_id, doc_id, score): the first places of each item in a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        before = np.cumsum([0, *(len(b.ids) for b in own.bundles)])
        for batch in batches:
            for k in range(batch.num_rows):
                bundle = batch.column("bundle")[k].as_py()
                item, doc, score = (batch.column(c)[k].values.to_numpy() for c in ("item", "doc", "score"))
                named = batch.column("ids")[k].values
                ids = named.fill_null(_LAST).to_numpy(zero_copy_only=False)[doc]
                order = np.lexsort((ids, -score, item))
                starts = np.flatnonzero(np.append(True, np.diff(item[order]) != 0)) if len(order) else np.empty(0, np.int64)
                place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
                order = order[place < own.top]
                columns = [
                    pa.array(before[bundle] + item[order], pa.int64()), pa.array([own.bundles[bundle].ids[i] for i in item[order]], pa.int64()),
                    named.take(pa.array(doc[order])), pa.array(score[order], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return run


def _round(spark: SparkSession, docs: DataFrame, rows: list[tuple[int | None, str | None]], top: int) -> DataFrame:
    numbers, bundles = bundles_of(rows, BUNDLE)
    vocabulary = spark.sparkContext.broadcast(numbers)
    blocks = stored(docs.mapInArrow(_index(vocabulary), _BLOCK), "postings")
    totals = blocks.agg(F.sum("filled"), F.sum("words")).first()
    df = np.zeros(max(len(numbers), 1), np.int64)
    for term, n in blocks.select("term").mapInArrow(_document_frequencies(len(df)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    plan = spark.sparkContext.broadcast(plan_of(totals[0] or 0, totals[1] or 0, df, bundles, OWNERS, top))
    none = F.array().cast("array<int>")
    every = F.array(*[F.struct(F.lit(k).alias("bundle"), F.sequence(F.lit(0), F.lit(len(b.ids) - 1)).alias("open")) for k, b in enumerate(bundles)])
    carried = blocks.select("block", "ids", F.inline(every)).select(
        "block", "bundle", "ids", none.alias("item"), none.alias("doc"), F.array().cast("array<long>").alias("score"), "open"
    )
    for stage in range(OWNERS):
        postings = blocks.select("block", "sizes", "at", "term", "tf").mapInArrow(_owned(plan, stage), _POSTINGS)
        carried = carried.groupBy("block", "bundle").cogroup(postings.groupBy("block", "bundle")).applyInArrow(_stage(plan, stage), _CARRIED)
    found = carried.select("bundle", "ids", "item", "doc", "score").mapInArrow(_ranked_in_block(plan), "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item, scores above 0 alone.

    Items are looked for in rounds of at most about ``ROUND_BYTES`` of item text,
    whose terms every task knows; a round reads the documents once, whole. Equal
    scores rank by ascending doc_id, nulls last. A null text has no terms; items
    without a match have no row; repeated documents rank one by one, and
    repeated items are ranked each for itself. Empty tables give an empty table;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0]
    out = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (("item_id", "long"), ("rank", "int"), ("doc_id", "long"), ("score", "long"))])
    rounds = -(-(size or 0) // ROUND_BYTES)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(rounds, 1)))
    for k in range(rounds):
        rows = sorted(((r[0], r[1]) for r in asked.where(number == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        if rows:
            own = _round(spark, texts, rows, top)
            out = own if rounds == 1 else out.unionByName(own)
    return out
