"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only documents have labels.

A sentence's chance of being toxic is a logistic model over its words and their
first letters; a document is toxic if any sentence is, so its chance is the
noisy-or 1 - prod(1 - p). Training follows that product, so the blame for a
document's label settles on the sentences that earn it, and the same sentence
scores locate them afterwards.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.common import slices
from tamperlens.llm.factor import held_out

BUCKETS = 2**18
# Letters of a word's beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
# Bounds of the sample that is fitted: rows per label, characters of a row, and characters per label.
FIT_ROWS, FIT_CHARS, FIT_TOTAL = 2500, 200_000, 8_000_000
# A feature counts if so many documents of the sample have it.
LEAST_DOCS = 3
# Steps of the fit, their size, and what a word has to earn, in documents: chance words fall back to 0.
ROUNDS, STEP, DECAY = 160, 0.25, 0.1
START = -11.0
TOXIC, OFFENDING = 0.3, 0.5
_MEMO = 400_000
# Bytes of a text that are split into words at once.
_PART = 1_000_000

# Words are ASCII letters, digits and apostrophes, and whatever is not ASCII; sentences end at these marks.
_ENDS = b".!?\n"
_TABLE = bytes(
    ord(".") if k in _ENDS else k + 32 if 65 <= k <= 90 else k if k >= 128 or chr(k).isalnum() or k == 39 else 32
    for k in range(256)
)
_END = re.compile(r"[.!?\n]")


def tokens(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, with a full stop at each end of a sentence; long texts in parts."""
    plain = data.translate(_TABLE)
    at = 0
    while at < len(plain):
        stop = len(plain) if len(plain) - at <= _PART else plain.rfind(b" ", at, at + _PART) + 1
        if stop <= at:
            stop = plain.find(b" ", at + _PART) + 1 or len(plain)
        yield plain[at:stop].replace(b".", b" . ").split()
        at = stop


def features(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings, in characters."""
    text = word.decode("utf-8", "replace")
    parts = [b"=" + word, *(text[:n].encode("utf-8", "replace") for n in BEGINNINGS if len(text) >= n)]
    return [zlib.crc32(p) % BUCKETS for p in parts]


class _Weights(dict):
    """Sum of the feature weights of each word met lately; the end of a sentence has no weight (nan)."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights
        self[b"."] = np.nan

    def __missing__(self, word: bytes) -> float:
        if len(self) >= _MEMO:
            self.clear()
            self[b"."] = np.nan
        value = self[word] = float(self.weights[features(word)].sum())
        return value


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def memo(self) -> _Weights:
        return _Weights(self.weights)

    def sentences(self, data: bytes, memo: _Weights) -> tuple[np.ndarray, np.ndarray]:
        """(number of each sentence that has a word, its log-odds). Sentences are numbered by the ends before them."""
        sums, counts = np.zeros(1), np.zeros(1)
        parts = []
        for words in tokens(data):
            values = np.fromiter(map(memo.__getitem__, words), float, len(words))
            ends = np.isnan(values)
            values[ends] = 0.0
            starts = np.append(0, np.flatnonzero(ends))
            z = np.add.reduceat(np.append(values, 0.0), starts)
            n = np.add.reduceat(np.append(~ends, False).astype(float), starts)
            # The first sentence of a part carries the last one on.
            z[0] += sums[-1]
            n[0] += counts[-1]
            parts.append((z[:-1], n[:-1]))
            sums, counts = z[-1:], n[-1:]
        z = np.concatenate([*(p for p, _ in parts), sums])
        n = np.concatenate([*(p for _, p in parts), counts])
        at = np.flatnonzero(n)
        return at, z[at] + self.bias


def noisy_or(z: np.ndarray) -> float:
    """Chance that at least one sentence is toxic, from their log-odds."""
    return float(-np.expm1(-np.logaddexp(0.0, np.clip(z, -40, 40)).sum()))


def spans(text: str, wanted: Iterable[int]) -> list[tuple[int, int]]:
    """(start, length), in code points, of the sentences with these numbers, without blanks around them."""
    cuts = [-1, *(m.start() for m in _END.finditer(text)), len(text)]
    out = []
    for k in wanted:
        start, stop = cuts[k] + 1, cuts[k + 1]
        own = text[start:stop]
        out.append((start + len(own) - len(own.lstrip()), len(own.strip())))
    return out


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Full-batch Adam on the noisy-or likelihood; both labels weigh alike. Without both, every score is 0."""
    model = Model(START, np.zeros(BUCKETS, np.float32))
    labels = {y for _, y in rows}
    if len(labels) < 2:
        model.bias = -40.0
        return model
    numbers: dict[bytes, int] = {}
    words, sentence, owner = (array("i") for _ in range(3))
    n = 0
    for doc, (text, _) in enumerate(rows):
        for part in tokens((text or "").encode("utf-8", "replace")):
            for w in part:
                if w == b".":
                    n += 1
                else:
                    words.append(numbers.setdefault(w, len(numbers)))
                    sentence.append(n)
                    owner.append(doc)
        n += 1
    if not words:
        model.bias = -40.0
        return model
    word, owner = np.array(words, np.int32), np.array(owner, np.int32)
    starts = np.flatnonzero(np.append(True, np.diff(np.array(sentence, np.int32)) > 0))
    del words, sentence
    bag = owner[starts]
    bags, first = np.unique(bag, return_index=True)
    lists = [features(w) for w in numbers]
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate([np.array(x, np.int32) for x in lists])
    of = np.repeat(np.arange(len(lists)), sizes)
    # Documents that have a feature: distinct (document, word) pairs, then distinct (document, feature) pairs.
    pairs = np.unique(owner.astype(np.int64) * len(lists) + word)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    docs, held = pairs // len(lists), pairs % len(lists)
    many = sizes[held]
    at = np.repeat(begin[held] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    seen = np.unique(np.repeat(docs, many) * BUCKETS + flat[at]) % BUCKETS
    common = np.bincount(seen, minlength=BUCKETS) >= LEAST_DOCS
    keep = common[flat]
    ids, back = np.unique(flat[keep], return_inverse=True)
    of = of[keep]
    y = np.array([rows[b][1] for b in bags], float)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    bag_of = np.repeat(np.arange(len(bags)), np.diff(np.append(first, len(bag))))
    sentence_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
    w, bias = np.zeros(len(ids)), START
    m, s = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, ROUNDS + 1):
        per_word = np.bincount(of, w[back], len(lists))
        z = np.clip(bias + np.add.reduceat(per_word[word], starts), -40, 40)
        total = np.bincount(bag_of, np.logaddexp(0.0, z), len(bags))
        # d loss / d z: p for clean documents; -p q / (1 - q) for toxic ones, q the chance that no sentence is.
        blame = np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-12), 1.0) * weight
        g = blame[bag_of] / (1 + np.exp(-z))
        per_word = np.bincount(word, g[sentence_of], len(lists))
        grad = np.append(np.bincount(back, per_word[of], len(ids)) + DECAY * weight.max(), g.sum())
        m += 0.1 * (grad - m)
        s += 0.01 * (grad**2 - s)
        move = STEP * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        # Words are evidence for toxicity, never against it: a long sentence does not outweigh one bad word.
        w = np.maximum(w - move[:-1], 0.0)
        # The bias learns slowly: what is toxic has to come from words.
        bias -= 0.1 * move[-1]
    model.bias = float(bias)
    model.weights[ids] = w
    return model


def training_rows(df: DataFrame, labels: DataFrame, may_learn: Column, text_col: str = "text") -> list[tuple[str, int]]:
    """A bounded, repeatable sample of labelled rows, alike for both labels; only ids are counted over all rows."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    size = F.length(F.col(text_col).cast("string"))
    rows = df.where(may_learn & F.col("doc_id").isNotNull() & (size <= FIT_CHARS)).select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.col(text_col).cast("string").alias("text")
    )
    eligible = rows.select("doc_id", "size").join(known, "doc_id")
    counts = {r["y"]: (r["n"], r["chars"]) for r in eligible.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).collect()}
    share = F.lit(0.0)
    for y, (n, chars) in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, FIT_ROWS / n, FIT_TOTAL / max(chars, 1)))).otherwise(share)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(2**30))
    # The ids are picked first, a bounded number, and sent to the texts: no text is shuffled.
    picked = eligible.where(order < share * 2**30).select("doc_id", "y").distinct().orderBy(order, "doc_id").limit(4 * FIT_ROWS)
    found = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").limit(4 * FIT_ROWS).collect()
    return [(r["text"], r["y"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


_SCORED = "doc_id long, held_out boolean, score double, n_sentences int, spans array<struct<start: int, length: int, score: double>>"


def _score(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        memo = own.memo()
        kinds = [pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))]
        for all_rows in batches:
            for batch in slices(all_rows, "text"):
                out = []
                for data in batch.column("text").cast(pa.binary()).to_pylist():
                    at, z = own.sentences(data or b"", memo)
                    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                    bad = np.flatnonzero(p >= OFFENDING)
                    found = []
                    if len(bad):
                        where = spans(data.decode("utf-8", "replace"), at[bad].tolist())
                        found = [{"start": a, "length": n, "score": float(p[k])} for (a, n), k in zip(where, bad)]
                    out.append((noisy_or(z), len(z), found))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "score", "n_sentences", "spans"])

    return run


def score_with(model: Model, df: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, n_sentences, spans): spans locate the offending sentences, in code points."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(sent), _SCORED)


def toxicity(df: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3 on), n_sentences, spans, one row per input row.

    Labels come from rows that are not held out, at most ``FIT_ROWS`` of each
    kind; an id with several labels counts with the largest. A text without words
    has no sentences and scores 0; without labels of both kinds every score is
    (nearly) 0. Repeated rows and null ids are scored like others, texts of any
    length whole. An empty table gives an empty table; other columns are not
    looked at.
    """
    model = fit(training_rows(df, labels, ~held_out(F.col("doc_id")), text_col))
    rows = score_with(model, df, text_col)
    predicted = F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted")
    return rows.select("doc_id", "held_out", "score", predicted, "n_sentences", "spans")
