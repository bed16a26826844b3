"""Near- and exact-duplicate operators against brute force."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamperlens.llm import fuse, minhash, rotcodes
from tamperlens.llm.components import components


def reach(nodes, links):
    at = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def test_components_of_chain_star_and_loop(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == reach({x for p in real for x in p}, real)


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def test_near_duplicates_of_texts(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        texts.append(base)
        for changes in (1, 1, 2, 3, 4, 5, 8):
            other = list(base)
            for k in rng.integers(0, 150, changes):
                other[k] = f"n{rng.integers(0, 10**6)}"
            texts.append(other)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: plain_shingles(t) for k, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(sets[k]) and r.kept == (want[k] == k) for k, r in got.items())


def test_awkward_texts(awkward, empty):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[2] == of[3] == of[1] == 1 and of[7] == of[8] == 7 and of[10] == 1
    assert [of[k] for k in (4, 5, 6)] == [4, 5, 6] and of[None] is None
    assert {r.n_shingles for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert minhash.near_duplicates(empty).count() == 0


def test_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "EXACT_BLOCK", 3)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[:k] + ["odd"] + base[k + 1 :])) for k in range(10, 40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {10}


def test_posterior_bounds_grow_and_spare_the_threshold():
    needed = minhash.least_matches()
    assert list(needed) == sorted(needed) and needed[-1] < 0.85 * minhash.HASHES
    rng = np.random.default_rng(1)
    kept = 0
    for _ in range(300):
        signs = np.stack([rng.integers(0, 2**16, minhash.HASHES)] * 2).astype("<u2")
        off = rng.random(minhash.HASHES) > 0.85
        signs[1, off] += 1
        kept += len(minhash.sequential(signs, np.array([0]), np.array([1]), needed))
    assert kept == 300


@pytest.mark.parametrize("block", [512, 5])
def test_near_duplicates_of_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(rotcodes, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 64))
    rows = [v for b in base for v in (b, b + rng.normal(size=64) * 0.15, b + rng.normal(size=64) * 0.3, b * 2)] + [base[0], base[0]]
    data = [(k, [float(np.float32(x)) for x in v], 1) for k, v in enumerate(rows)]
    data += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [1.0, None], 1), (904, [float("inf")] * 64, 1), (905, [], 1), (None, [1.0] * 64, 1), (906, [1.0, 2.0], 2), (907, [2.0, 4.0], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rep int")
    got = {r.vec_id: r for r in rotcodes.near_duplicates(df).collect()}
    unit = np.array([np.array(v[1], float) / np.linalg.norm(v[1]) for v in data[: len(rows)]])
    near = unit @ unit.T >= 0.95
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if near[a, b]]
    want = reach(range(len(rows)), links)
    assert len(got) == len(data)
    for k in range(len(rows)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum() - 1, want[k], want[k] == k)
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904, 905))
    assert got[906].n_links == 1 and got[907].component_id == 906
    assert rotcodes.near_duplicates(df.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(400, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    made = rotcodes.codes(unit)
    assert made[0].shape == (400, 5 * 32)
    true = unit @ unit.T
    off = ~np.eye(400, dtype=bool)
    error = (rotcodes.estimates(*made, 256) - true)[off]
    assert abs(error.mean()) < 0.002 and error.std() < 0.06
    assert (rotcodes.upper_bounds(*made, 256) >= true - 1e-6).all()


def test_codes_spare_pairs_at_the_threshold_and_give_up_most_others():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    unit = np.concatenate([a, 0.95 * a + np.sqrt(1 - 0.95**2) * b])
    bounds = rotcodes.upper_bounds(*rotcodes.codes(unit), 256)
    assert all(bounds[k, k + 300] >= 0.95 for k in range(300))
    assert (bounds[:300, :300][~np.eye(300, dtype=bool)] < 0.95).mean() > 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_filters_admit_all_their_keys_and_few_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    made = fuse.build(keys)
    assert fuse.admits(keys, *made).all()
    others = np.random.default_rng(99).integers(0, 2**63, 20_000).astype(np.uint64)
    assert fuse.admits(others, *made).mean() < 0.02


@pytest.mark.parametrize("shard_keys", [2, 1000])
def test_exact_duplicates(awkward, empty, shard_keys):
    new = F.col("doc_id") % 2 == 1
    rows = fuse.exact_duplicates(awkward, new, shard_keys=shard_keys).collect()
    texts: dict[str, list] = {}
    table = [(r.doc_id, r.text or "") for r in awkward.collect()]
    for k, t in table:
        texts.setdefault(t, []).append(k)
    want = sorted(
        (str(k), str(max((x for x in texts[t] if x is not None), default=None)), len(texts[t]), hashlib.sha256(t.encode()).hexdigest())
        for k, t in table
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert fuse.exact_duplicates(empty, new).count() == 0
