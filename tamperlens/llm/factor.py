"""Factorisation machine for text quality: hashed words, structure statistics and metadata, with low-rank interactions.

A score is s(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)):
linear in the number of features, however many pairs interact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2**15
BINS = 8
RANK = 8
# Bounds of the sample that is fitted: rows per label, and characters of a row that may be in it.
FIT_ROWS, FIT_CHARS = 1500, 30_000
ROUNDS = 60
KEEP = 0.7
_MEMO = 400_000
STATISTICS = (
    "log_bytes", "word_length", "letters", "capitals", "digits", "blanks", "marks", "other_bytes", "log_lines", "line_length",
    "distinct_words", "repeats", "ends_in_mark", "capital_words", "longest_word", "metadata_chars",
)


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % BUCKETS
        return bucket


_BUCKETS = _Buckets()
_CLASS = np.full(256, 5, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(b" \t\n\v\f\r")] = 3
_CLASS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 4
_MARKS = frozenset(b"!\"#$%&*+-/<=>?@^_`|~")


def features(text: str | None, chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the structure statistics with the stated length (nan: unknown)."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    buckets = np.fromiter(map(_BUCKETS.__getitem__, words), np.int32, len(words))
    distinct = np.unique(buckets)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6) / size
    lines = data.count(b"\n") + 1
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    repeats = float((buckets[1:] == buckets[:-1]).mean()) if len(words) > 1 else 0.0
    letters = kinds[0] + kinds[1]
    values = [
        np.log1p(len(data)), lengths.sum() / n, letters, kinds[1] / max(letters, 1e-9), kinds[2], kinds[3], kinds[4], kinds[5],
        np.log1p(lines), np.log1p(size / lines), len(distinct) / n, repeats, sum(w[-1] in _MARKS for w in words) / n,
        sum(w[:2].isupper() and len(w) > 1 for w in words) / n, np.log1p(lengths.max(initial=0)),
        np.nan if chars is None or chars != chars else np.log1p(max(float(chars), 0.0)),
    ]
    return distinct, np.array(values)


@dataclass
class Machine:
    """Fitted weights; features are word buckets, then bins of each statistic (the last bin: unknown)."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def active(self, text: str | None, chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        distinct, values = features(text, chars)
        bins = (self.edges < values[:, None]).sum(axis=1)
        bins[np.isnan(values)] = BINS
        ids = np.concatenate([distinct, BUCKETS + np.arange(len(values)) * (BINS + 1) + bins])
        return ids, np.concatenate([np.full(len(distinct), 1 / np.sqrt(max(len(distinct), 1))), np.ones(len(values))])

    def score(self, text: str | None, chars: float | None) -> float:
        ids, x = self.active(text, chars)
        v = self.factors[ids] * x[:, None]
        z = self.bias + self.weights[ids] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[str | None, float | None, int]]) -> Machine:
    """Fit by full-batch Adam on the logistic loss; classes weigh alike. Without both labels every score is 0.5."""
    total = BUCKETS + len(STATISTICS) * (BINS + 1)
    rng = np.random.default_rng(7)
    machine = Machine(np.zeros((len(STATISTICS), BINS - 1)), 0.0, np.zeros(total), rng.normal(0, 0.01, (total, RANK)))
    y = np.array([label for _, _, label in rows], float)
    if not len(y) or y.min() == y.max():
        machine.factors[:] = 0
        return machine
    values = np.array([features(t, c)[1] for t, c, _ in rows])
    known = [col[~np.isnan(col)] for col in values.T]
    machine.edges = np.array([np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]) if len(c) else np.zeros(BINS - 1) for c in known])
    parts = [machine.active(t, c) for t, c, _ in rows]
    row = np.repeat(np.arange(len(parts)), [len(i) for i, _ in parts])
    ids, x = (np.concatenate(p) for p in zip(*parts))
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in (("b", np.zeros(1)), ("w", machine.weights), ("v", machine.factors))}
    bias = np.zeros(1)
    for step in range(1, ROUNDS + 1):
        vx = machine.factors[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx**2).sum(axis=1), starts)
        z = bias[0] + np.add.reduceat(machine.weights[ids] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gx = g[row] * x
        gw = np.bincount(ids, gx, total) + 1e-4 * machine.weights
        gv = np.stack([np.bincount(ids, gx * (sums[row, f] - vx[:, f]), total) for f in range(RANK)], axis=1) + 1e-4 * machine.factors
        for name, param, grad in (("b", bias, np.array([g.sum()])), ("w", machine.weights, gw), ("v", machine.factors, gv)):
            m, s = state[name]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            param -= (0.1 if name != "v" else 0.02) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    machine.bias = float(bias[0])
    return machine


def training_rows(df: DataFrame, labels: DataFrame, may_learn: Column, text_col: str = "text") -> list[tuple]:
    """A bounded, repeatable sample of labelled rows, alike for both labels; only ids are counted over all rows."""
    chars = F.col("n_chars") if "n_chars" in df.columns else F.lit(None)
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), chars.cast("double").alias("chars"), may_learn.alias("_may")
    ).where("_may and doc_id is not null and length(text) <= " + str(FIT_CHARS))
    eligible = rows.select("doc_id").join(known, "doc_id")
    counts = {r[0]: r[1] for r in eligible.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, FIT_ROWS / n))).otherwise(share)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(2**30))
    # The ids are picked first, a bounded number, and sent to the texts: no text is shuffled.
    picked = eligible.where(order < share * 2**30).distinct().orderBy(order, "doc_id").limit(4 * FIT_ROWS)
    found = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "chars", "y").limit(4 * FIT_ROWS).collect()
    return [(r["text"], r["chars"], r["y"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"] or ""))]


def score_column(machine: Machine, df: DataFrame, text_col: str = "text") -> Column:
    """Score of every row, 0 to 1, from its text and stated length."""
    sent = df.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, chars in parts:
            yield pd.Series([sent.value.score(t, c) for t, c in zip(texts, chars)], dtype="float64")

    chars = F.col("n_chars") if "n_chars" in df.columns else F.lit(None)
    return score(F.col(text_col).cast("string"), chars.cast("double"))


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


def quality(df: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 on), one row per input row.

    Labels come from rows that are not held out; an id with several labels
    counts with the largest. Null and empty texts are scored by their structure;
    a missing or null stated length is a feature of its own; without labels of
    both kinds every score is 0.5. An empty table gives an empty table.
    """
    machine = fit(training_rows(df, labels, ~held_out(F.col("doc_id")), text_col))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score_column(machine, df, text_col).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= KEEP, 1).otherwise(0))
