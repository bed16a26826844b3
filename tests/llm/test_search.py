"""Ranked search against scores of every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tamperlens.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def plain(docs, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    N, L = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for (d, c), n in zip(held, sizes):
            score = 0
            for w in terms(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * (25 + 75 * n * N // L)))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return out


def frames(spark, docs, items):
    a = spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in docs], "doc_id long, text string, item_id int, block int, term string, score int")
    b = spark.createDataFrame([(i, t, 9, 9) for i, t in items], "item_id long, text string, rank int, doc_id int")
    return a, b


def run(spark, docs, items):
    a, b = frames(spark, docs, items)
    return sorted((tuple(r) for r in search.search(a.repartition(3), b).collect()), key=str)


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "it's", "A-B", "don\x00t"]
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda size: " ".join(rng.choice(words, size, p=weights / weights.sum()))
    docs = [(k, text(rng.integers(1, 60))) for k in range(n)]
    docs += [(1000 + k, docs[3][1]) for k in range(30)] + [(2000, None), (2001, ""), (2002, "..."), (None, "w1 w9 w50"), (5, "w1 W9 w50"), (2003, "w2 " * 5000)]
    return docs, [(k, text(12)) for k in range(20)] + [(50, None), (51, ""), (52, "nothing known"), (None, "w9 w9 w200"), (53, docs[3][1])]


@pytest.mark.parametrize("limits", [{}, {"BUNDLE": 3, "BLOCK_DOCS": 25, "OWNERS": 3}, {"ROUND_BYTES": 300, "BLOCK_BYTES": 500}])
def test_all_ranks(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    docs, items = corpus(4)
    assert run(spark, docs, items) == sorted(plain(docs, items), key=str)


def test_parts_of_a_long_text_are_its_terms(monkeypatch):
    monkeypatch.setattr(search, "_PART", 20)
    text = "Some words, then " + "x" * 90 + " é and\tmore 12ab" * 9
    assert [w.decode() for part in search.terms(text.encode()) for w in part] == terms(text)


def test_empty_tables(spark):
    a, b = frames(spark, [(1, "w1")], [(1, "w1")])
    assert search.search(a, b.limit(0)).count() == 0
    assert search.search(a.limit(0), b).count() == 0
    assert search.search(a.limit(0), b).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_pruned_accumulators_cannot_win():
    rng = np.random.default_rng(1)
    rows = [(1, " ".join(rng.choice([f"t{k}" for k in range(30)], 15)))]
    numbers, bundles = search.bundles_of(rows, 4)
    df = rng.integers(1, 400, len(numbers))
    plan = search.plan_of(400, 90_000, df, bundles, 4, 3)
    assert sorted(set(plan.owner)) == [0, 1, 2, 3]
    state = (np.empty(0, int), np.empty(0, int), np.empty(0, np.int64), np.zeros(1, int))
    total = np.zeros(50, np.int64)
    for stage in range(4):
        at, term, gain = [], [], []
        for t in np.flatnonzero(plan.owner == stage):
            docs = rng.choice(50, 20, replace=False)
            g = plan.weights[t] * rng.integers(100_000, 900_000, 20)
            at, term, gain = [*at, *docs], [*term, *[t] * 20], [*gain, *g]
            total[docs] += g * bundles[0].often[bundles[0].term == t][0]
        state = search.visit(plan, stage, bundles[0], np.arange(50), state, (np.array(at, int), np.array(term, int), np.array(gain, np.int64)))
    best = np.sort(total)[::-1][:3]
    assert sorted(state[2].tolist(), reverse=True)[:3] == best.tolist()
