"""Language identification by a linear-chain conditional random field over words.

Every word has emission weights from its affixes and inner n-grams (letters
between boundary marks), from itself and from learned lexicons; neighbours are
tied by learned transitions. Forward-backward gives each word its posterior, so
that code-switched text is labelled word by word; a document takes the language
with the largest mean posterior.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.common import slices

TABLE = 2**18
GRAMS = (1, 2, 3, 4)
# Bounds of the fitted sample: rows per language, characters of a row in it, languages, words of a lexicon.
FIT_ROWS, FIT_CHARS, FIT_LANGUAGES, LEXICON = 250, 8_000, 64, 5_000
ROUNDS = 25
SPAN = 32
_MEMO = 300_000
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def occurrences(words: list[str], lexicon: dict[str, int], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after another, and where each word starts.

    A word stands between ``^`` and ``$``, so n-grams at its edges are its
    affixes. A word without letters has one feature that no word with letters has.
    """
    plain = [f"^{_NOT_LETTERS.sub('', w.lower())}$" for w in words]
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word_of = np.repeat(np.arange(len(plain)), lengths)
    ids, owner = [], []
    for n in GRAMS:
        at = np.arange(max(len(points) - n + 1, 0))
        at = at[at + n <= ends[word_of[at]]]
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = (value ^ points[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        ids.append((value % np.uint64(TABLE)).astype(np.int64))
        owner.append(word_of[at])
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % TABLE for w in plain), np.int64, len(plain))
    listed = np.fromiter((TABLE + lexicon.get(w[1:-1], languages) for w in plain), np.int64, len(plain))
    ids += [whole, listed]
    owner += [np.arange(len(plain))] * 2
    flat, own = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return flat[order], np.searchsorted(own[order], np.arange(len(plain)))


@dataclass
class Field:
    """Languages, feature weights, transition and start weights, lexicon (word -> language number)."""

    languages: list[str]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, starts = occurrences(words, self.lexicon, len(self.languages))
        return np.add.reduceat(self.weights[ids], starts, axis=0)


def marginals(potentials: np.ndarray, lengths: np.ndarray, steps: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posterior of each label at each position of sequences laid end to end (exact forward-backward).

    Sequences are cut into spans that advance together. A span's product of
    matrices carries messages across it, so a very long sequence takes as many
    steps as a span is long, plus its number of spans. With ``pairs``, also the
    expected number of each transition.
    """
    total, labels = potentials.shape
    emit = np.exp(potentials - potentials.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    move = np.exp(steps - steps.max()).astype(np.float32)
    begin = np.exp(start - start.max()).astype(np.float32)
    spans = -(-lengths // SPAN)
    count = int(spans.sum())
    if not count:
        return (potentials.astype(np.float32), np.zeros((labels, labels))) if pairs else potentials.astype(np.float32)
    owner = np.repeat(np.arange(len(lengths)), spans)
    first_span = np.cumsum(spans) - spans
    number = np.arange(count) - first_span[owner]
    base = (np.cumsum(lengths) - lengths)[owner] + number * SPAN
    size = np.minimum(SPAN, lengths[owner] - number * SPAN)
    place = base[None, :] + np.arange(SPAN)[:, None]
    real = np.arange(SPAN)[:, None] < size[None, :]
    e = emit[np.where(real, place, 0)]
    opens = number == 0
    # Products over spans, only needed where a sequence has several.
    product = np.broadcast_to(np.eye(labels, dtype=np.float32), (count, labels, labels)).copy()
    longer = spans[owner] > 1
    if longer.any():
        sub = np.flatnonzero(longer)
        p = product[sub]
        for k in range(SPAN):
            moved = p @ move
            if k == 0:
                moved[opens[sub]] = (p * begin)[opens[sub]]
            moved = moved * e[k, sub][:, None, :]
            moved /= moved.sum(axis=(1, 2), keepdims=True)
            p = np.where(real[k, sub][:, None, None], moved, p)
        product[sub] = p
    ahead = np.ones((count, labels), np.float32)
    behind = np.ones((count, labels), np.float32)
    most = int(spans.max())
    for j in range(1, most):
        at = first_span[spans > j] + j
        v = np.einsum("ni,nij->nj", ahead[at - 1], product[at - 1])
        ahead[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(most - 1, 0, -1):
        at = first_span[spans > j] + j
        v = np.einsum("nij,nj->ni", product[at], behind[at])
        behind[at - 1] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((SPAN, count, labels), np.float32)
    now = ahead
    for k in range(SPAN):
        moved = now @ move
        if k == 0:
            moved[opens] = begin
        moved = moved * e[k]
        moved /= moved.sum(axis=1, keepdims=True)
        now = np.where(real[k][:, None], moved, now)
        alpha[k] = now
    out = np.empty((total, labels), np.float32)
    expected = np.zeros((labels, labels))
    beta = behind
    for k in range(SPAN - 1, -1, -1):
        gamma = alpha[k] * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        out[place[k][real[k]]] = gamma[real[k]]
        after = e[k] * beta
        if pairs:
            before = alpha[k - 1] if k else ahead
            use = real[k] & ~opens if k == 0 else real[k]
            joint = before[use][:, :, None] * move[None] * after[use][:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = after @ move.T
        back /= back.sum(axis=1, keepdims=True)
        beta = np.where(real[k][:, None], back, beta)
    return (out, expected) if pairs else out


def _lexicon(docs: list[tuple[list[str], int]], languages: int) -> dict[str, int]:
    """Words that nearly always stand in texts of one language, the most frequent ones per language."""
    counts: list[Counter] = [Counter() for _ in range(languages)]
    for words, label in docs:
        counts[label].update(_NOT_LETTERS.sub("", w.lower()) for w in words)
    total = sum(counts, Counter())
    out = {}
    for label, own in enumerate(counts):
        sure = [(n, w) for w, n in own.items() if w and n >= 3 and n >= 0.9 * total[w]]
        out.update((w, label) for _, w in sorted(sure, key=lambda x: (-x[0], x[1]))[:LEXICON])
    return out


def fit(rows: list[tuple[str, str]]) -> Field:
    """Fit on (text, language) rows. Pieces of texts of different languages are joined, so that the transitions
    learn to switch. No row with words gives a field without languages."""
    languages = sorted({lang for _, lang in rows})
    docs = [(text.split(), languages.index(lang)) for text, lang in rows]
    docs = [(words, label) for words, label in docs if words]
    L = len(languages)
    if not docs:
        return Field([], np.zeros((TABLE + 1, 0)), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(5)
    pieces = []
    for words, label in docs:
        at = 0
        while at < len(words):
            size = int(rng.integers(5, 60))
            pieces.append((words[at : at + size], label))
            at += size
    order = rng.permutation(len(pieces))
    lexicon = _lexicon(docs, L)
    words, labels, lengths = [], [], []
    k = 0
    by_label = [[i for i in order if pieces[i][1] == label] for label in range(L)]
    while any(by_label):
        # Sequences of up to four pieces; a piece in four changes the language.
        label, n = int(rng.choice([i for i in range(L) if by_label[i]])), 0
        for _ in range(4):
            if not by_label[label] or rng.random() < 0.25:
                label = int(rng.choice([i for i in range(L) if by_label[i]])) if any(by_label) else label
            if not by_label[label]:
                break
            piece = pieces[by_label[label].pop()]
            words += piece[0]
            labels += [label] * len(piece[0])
            n += len(piece[0])
        lengths.append(n)
        k += 1
    types: dict[str, int] = {}
    token = np.array([types.setdefault(w, len(types)) for w in words])
    labels, lengths = np.array(labels), np.array(lengths)
    ids, starts = occurrences(list(types), lexicon, L)
    counts = np.diff(np.append(starts, len(ids)))
    size = TABLE + L + 1
    used, slot = np.unique(ids, return_inverse=True)
    params = {"w": np.zeros((len(used), L)), "t": np.zeros((L, L)), "s": np.zeros(L)}
    state = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in params.items()}
    del docs, pieces, by_label, words, ids
    onehot = np.eye(L, dtype=np.float32)[labels]
    opens = np.cumsum(lengths) - lengths
    inner = np.ones(len(labels), bool)
    inner[opens] = False
    seen = np.zeros((L, L))
    np.add.at(seen, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    for step in range(1, ROUNDS + 1):
        # One label after another: arrays of all features by all labels would be the peak of the memory.
        emission = np.stack([np.add.reduceat(params["w"][:, c][slot], starts) for c in range(L)], axis=1)
        post, moves = marginals(emission[token], lengths, params["t"], params["s"], pairs=True)
        gap = onehot - post
        per_type = [np.bincount(token, gap[:, c], len(types)) for c in range(L)]
        grads = {
            "w": np.stack([np.bincount(slot, np.repeat(g, counts), len(used)) for g in per_type], axis=1) / len(labels) - 1e-6 * params["w"],
            "t": (seen - moves) / len(labels),
            "s": gap[opens].sum(axis=0) / len(labels),
        }
        for name, p in params.items():
            m, s = state[name]
            m += 0.1 * (grads[name] - m)
            s += 0.01 * (grads[name] ** 2 - s)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((size, L), np.float32)
    weights[used] = params["w"]
    return Field(languages, weights, params["t"], params["s"], lexicon)


class _Memo(dict):
    """Row numbers of the emissions of words seen lately."""

    def __init__(self, model: Field) -> None:
        self.model, self.rows = model, np.zeros((0, len(model.languages)), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > _MEMO:
            self.clear()
            self.rows, new = self.rows[:0], list(words)
        parts = [self.rows]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.update(zip(some, range(len(self), len(self) + len(some))))
            parts.append(self.model.emissions(some).astype(np.float32))
        self.rows = np.concatenate(parts)


_MEMOS: dict[str, _Memo] = {}


def posteriors(model: Field, memo: _Memo, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    split = [(t or "").split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    memo.learn(set().union(*split))
    at = np.fromiter((memo[w] for words in split for w in words), np.int64, int(lengths.sum()))
    return split, lengths, marginals(memo.rows[at], lengths, model.steps, model.start)


def predict(model: Field, texts: list[str | None], memo: _Memo | None = None) -> list[tuple[str, float, int]]:
    """(language, mean posterior, words of another language) per text; ``und`` without a letter or a model."""
    if not model.languages:
        return [(UNKNOWN, 0.0, 0)] * len(texts)
    memo = memo if memo is not None else _Memo(model)
    _, lengths, post = posteriors(model, memo, texts)
    out, at = [], 0
    for text, n in zip(texts, lengths.tolist()):
        mine = post[at : at + n]
        at += n
        if not text or not _LETTER.search(text):
            out.append((UNKNOWN, 0.0, 0))
            continue
        mean = mine.mean(axis=0, dtype=np.float64)
        best = int(mean.argmax())
        out.append((model.languages[best], float(min(max(mean[best], 0.0), 1.0)), int((mine.argmax(axis=1) != best).sum())))
    return out


def training_rows(df: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """A bounded, repeatable sample, alike for the most frequent languages."""
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), may_learn.alias("_may")
    ).where(f"_may and doc_id is not null and lang is not null and length(text) between 1 and {FIT_CHARS}")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LANGUAGES).collect()
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, FIT_ROWS / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < share * 2**30
    found = rows.where(drawn).select("doc_id", "text", "lang").limit(2 * FIT_ROWS * max(len(counts), 1)).collect()
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"], r["lang"]))]


def identify_with(model: Field, df: DataFrame, columns: dict[str, str], text_col: str = "text") -> DataFrame:
    """Carry the named columns through and add lang_pred, score, other_words; a single pass without a shuffle.

    ``columns`` maps names to types; a text column among them must be named so.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MEMOS:
            _MEMOS.clear()
            _MEMOS[key] = _Memo(sent.value)
        for whole in batches:
            for batch in slices(whole, "_text"):
                made = predict(sent.value, batch.column("_text").to_pylist(), _MEMOS[key])
                added = [pa.array(c, k) for c, k in zip(zip(*made), (pa.string(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), *added], [*columns, "lang_pred", "score", "other_words"]
                )

    kinds = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    rows = df.select(*[F.col(c) for c in columns], F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, other_words long")


def identify(df: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, other_words: one row per input row.

    Learned from rows for which ``may_learn`` holds and a language is given;
    prediction reads the text alone. Null texts and texts without a letter are
    ``und`` with score 0, as are all without anything to learn from. Ties fall to
    the language that is first in order. Repeated rows get equal results; an
    empty table gives an empty table.
    """
    model = fit(training_rows(df, may_learn, text_col, lang_col))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), (~may_learn).alias("held_out"), F.col(text_col).alias("body"))
    return identify_with(model, rows, {"doc_id": "long", "held_out": "boolean"}, "body")


def label_words(model: Field, df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, at, word, lang, posterior: one row per word."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, names = _Memo(sent.value), sent.value.languages
        for whole in batches:
            for batch in slices(whole, "text"):
                if not names:
                    continue
                split, lengths, post = posteriors(sent.value, memo, batch.column("text").to_pylist())
                best = post.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.asarray(batch.column("doc_id").to_pylist(), object), lengths), pa.int64()),
                        pa.array(np.concatenate([np.arange(n) for n in lengths.tolist()] or [np.empty(0, int)]), pa.int64()),
                        pa.array([w for words in split for w in words], pa.string()),
                        pa.array([names[b] for b in best.tolist()], pa.string()),
                        pa.array(post.max(axis=1).astype(float)),
                    ],
                    ["doc_id", "at", "word", "lang", "posterior"],
                )

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, at long, word string, lang string, posterior double")
