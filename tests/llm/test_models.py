"""Learned operators: held-out accuracy, exact forward-backward, the interaction identity."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamperlens.llm import crf, factor

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("lengths", [[1], [3, 1, 5], [70, 2, 33], [0, 4, 0]])
def test_marginals_match_enumeration_or_plain_recursion(lengths):
    rng = np.random.default_rng(1)
    potentials, steps, start = rng.normal(size=(sum(lengths), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    got = crf.marginals(potentials, np.array(lengths), steps, start)
    at = 0
    for n in lengths:
        own = potentials[at : at + n]
        if 0 < n <= 6:
            want = np.zeros((n, 2))
            for path in product(range(2), repeat=n):
                value = np.exp(start[path[0]] + sum(own[k, y] for k, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
                for k, y in enumerate(path):
                    want[k, y] += value
        else:
            forward, backward = np.zeros((n, 2)), np.ones((n, 2))
            for k in range(n):
                forward[k] = np.exp(own[k]) * (np.exp(start) if k == 0 else forward[k - 1] @ np.exp(steps))
                forward[k] /= forward[k].sum()
            for k in range(n - 2, -1, -1):
                backward[k] = np.exp(steps) @ (np.exp(own[k + 1]) * backward[k + 1])
                backward[k] /= backward[k].sum()
            want = forward * backward
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = crf.identify(docs, ~factor.held_out(F.col("doc_id"))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = crf.fit(crf.training_rows(docs, F.lit(True)))
    mixed = spark.createDataFrame([(1, "the thing of theand erthe the with enden und ungkeit lichung der heit")], "doc_id long, text string")
    labels = [r.lang for r in crf.label_words(model, mixed).orderBy("at").collect()]
    assert labels[0] == "en" and labels[-1] == "de"


def test_awkward_languages(awkward, empty):
    rows = {r.doc_id: r for r in crf.identify(awkward, F.lit(True)).collect()}
    assert {rows[k].lang_pred for k in (4, 5, 6, 11)} == {"und"}
    assert rows[1].lang_pred in ("en", "fr", "de")
    assert crf.identify(empty, F.lit(True)).count() == 0
    none = crf.identify(awkward, F.lit(False)).collect()
    assert len(none) == awkward.count() and {r.lang_pred for r in none} == {"und"}


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = factor.quality(docs, labels)
    assert rows.count() == docs.count()
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in held)


def test_interactions_are_those_of_all_pairs():
    machine = factor.fit([("good words here", 15.0, 1), ("BAD BAD!!", 9.0, 0), ("fine words", None, 1), ("$$ ## $$", 8.0, 0)])
    ids, x = machine.active("good BAD words", 3.0)
    v = machine.factors[ids] * x[:, None]
    pairs = sum(v[i] @ v[j] for i in range(len(ids)) for j in range(i))
    z = machine.bias + machine.weights[ids] @ x + pairs
    assert np.isclose(machine.score("good BAD words", 3.0), 1 / (1 + np.exp(-z)))


def test_awkward_quality(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 1, 1), (12, None, 0), (7, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = factor.quality(awkward, some).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert factor.quality(empty, labels).count() == 0
