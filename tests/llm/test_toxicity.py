"""Toxicity: held-out accuracy, sentences found, the noisy-or and its gradient."""

from __future__ import annotations

import numpy as np

from tamperlens.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_places(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels)
    held = rows.where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert rows.count() == docs.count()
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.85
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in held)
    found = [r.text[s.start : s.start + s.length] for r in held if r.toxic for s in r.spans]
    assert found and all(x == x.strip() and not set(x) & set(".!?\n") for x in found)
    bad = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid"}
    marked = [x for x in found if x.isascii() and not any(x.startswith(p) for p in ("lowei", "lostra"))]
    assert np.mean([bool(bad & set(x.lower().replace(",", " ").split())) for x in marked]) > 0.8


def test_one_bad_sentence_makes_a_bag_toxic():
    clean = ["the sky is blue", "a cat sat down", "we read some books", "it rains a lot"]
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        some = list(rng.choice(clean, 5))
        if k % 2:
            some.insert(int(rng.integers(0, 5)), "you utter scoundrel")
        rows.append((". ".join(some), k % 2))
    model = toxicity.fit(rows)
    text = "The sky is blue. You utter scoundrel!\nIt rains a lot"
    at, z = model.sentences(text.encode(), model.memo())
    # The line feed behind the mark ends an empty sentence.
    assert at.tolist() == [0, 1, 3] and (z > 0).tolist() == [False, True, False]
    (start, length) = toxicity.spans(text, [1])[0]
    assert text[start : start + length] == "You utter scoundrel"
    p = 1 / (1 + np.exp(-z))
    assert np.isclose(toxicity.noisy_or(z), 1 - np.prod(1 - p))


def test_parts_of_a_long_text_make_the_same_sentences(monkeypatch):
    model = toxicity.Model(-1.0, np.random.default_rng(1).normal(size=toxicity.BUCKETS))
    text = ("One two three. " + "word " * 50 + "! ..\n é ö? " + "y" * 120 + " end " * 9).encode()
    whole = model.sentences(text, model.memo())
    monkeypatch.setattr(toxicity, "_PART", 30)
    parts = model.sentences(text, model.memo())
    assert whole[0].tolist() == parts[0].tolist() and np.allclose(whole[1], parts[1])


def test_awkward_toxicity(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, 1, 1), (12, None, None), (7, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.toxicity(awkward, some).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
        assert {(r.n_sentences, r.predicted) for r in rows if r.doc_id in (4, 5, 6)} == {(0, 0)}
    assert toxicity.toxicity(empty, labels).count() == 0
