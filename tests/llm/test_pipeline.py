"""Pipeline stages on repeated ids and rows, clashing names, awkward and empty tables, and against brute force."""

from __future__ import annotations

import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, _text string, score double, lang_pred string, _score int, row_key string, row_number int, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", 1.0, "b", 2, "c", 3, None if t is None else len(t)) for d, t in rows], SHAPE).repartition(3)


def left(stage, spark, docs):
    kept = stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)


BASE = " ".join(f"word{k} thing{k % 7}" for k in range(60))
OTHER = " ".join(f"quite another text {k}" for k in range(40))


def test_exact_stage_loses_no_text_and_keeps_one_row(spark):
    rows = [(1, BASE), (2, BASE), (2, BASE), (2, OTHER), (3, None), (4, ""), (None, BASE), (None, "only here"), (5, OTHER + "."), (6, "x" * 200_000), (6, "x" * 200_000)]
    want = [(2, BASE), (2, OTHER), (4, ""), (None, "only here"), (5, OTHER + "."), (6, "x" * 200_000)]
    assert left(pipeline.exact_stage, spark, table(spark, rows)) == sorted(want, key=str)


def test_near_stage_loses_no_text_and_keeps_one_row(spark):
    rows = [(9, BASE), (5, BASE + " end"), (5, OTHER), (7, OTHER), (7, OTHER), (8, None), (8, None), (4, ""), (3, "four words are here"), (None, "no id"), (2, "word " * 100_000)]
    got = left(pipeline.near_stage, spark, table(spark, rows))
    want = [(5, BASE + " end"), (5, OTHER), (8, None), (8, None), (4, ""), (3, "four words are here"), (None, "no id"), (2, "word " * 100_000)]
    assert got == sorted(want, key=str)


def test_filters_carry_clashing_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(docs[0].doc_id, docs[0].text), (-1, None), (-2, ""), (-3, "123 !!!")]
    frame = table(spark, rows)
    for stage in (pipeline.quality_stage, pipeline.language_stage):
        got = Counter(left(stage, spark, frame))
        assert not got - Counter(rows)
        # Equal rows share their fate.
        assert got[(docs[0].doc_id, docs[0].text)] in (0, 2)
    assert not {d for d, _ in left(pipeline.language_stage, spark, frame)} & {-1, -2, -3}


def test_empty_tables(spark):
    nothing = table(spark, [(1, "x")]).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    exact = pipeline.exact_stage(spark, docs, SMALL).cache()
    return docs.collect(), exact.collect(), pipeline.near_stage(spark, exact, SMALL).collect()


def test_deduplication_is_that_of_brute_force(kept):
    docs, exact, near = kept
    largest = {}
    for r in docs:
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(largest.values())
    sets = {}
    for r in exact:
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}
    at = {d: d for d in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(len(links) + 1):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    assert sorted(r.doc_id for r in near) == sorted(d for d in at if at[d] == d)
