"""BPE and packing against the tokenizers' own libraries, and packing invariants."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamperlens.llm import bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
FILE = P.path("byte_bpe_50k.json")
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})


def test_bpe_matches_and_decodes(awkward, empty):
    rows = bpe.digests(awkward, RANKS, P.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert len(rows) == awkward.count()
    for r in rows:
        ids = OWN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0


def test_words_start_again_when_too_many(awkward, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    monkeypatch.setattr(bpe, "SLICE", 50)
    got = {r.doc_id: r.ids for r in bpe.encode(awkward.coalesce(1), RANKS, P.PATTERN).collect()}
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert all(OWN.encode_ordinary(texts[k]) == ids for k, ids in got.items())


def test_a_rank_is_found_at_one_place():
    """The fold looks a pair up once: offset of the first id, then the second id; all else is no rank there."""
    offsets, table = (np.array(x.split(","), np.int64) for x in bpe.rank_table(RANKS))
    pairs = bpe.pair_ranks(RANKS)
    a, b = np.array(list(pairs)).T + 1
    assert (((table[offsets[a] + b] ^ (a << 44)) >> 27) == np.array(list(pairs.values())) + 1).all()
    draw = np.random.default_rng(1)
    a, b = draw.integers(1, 65536, (2, 200_000))
    other = np.array([p not in pairs for p in zip((a - 1).tolist(), (b - 1).tolist())])
    assert ((table[offsets[a] + b] ^ (a << 44)) >= bpe._NONE)[other].all()


def test_folded_words_have_the_ids_of_the_library(spark):
    """Words of every length up to the fold's limit and beyond it, with ties, with no merge and with one byte left over."""
    draw = np.random.default_rng(2)
    words = ["".join(draw.choice(list(letters), n)) for letters in ("ab", "etaoinshr", "zqxé你") for n in (2, 3, 5, 9, 28, 200, 511, 512, 513, 700)]
    rows = [(k, f" {w}") for k, w in enumerate([*words, "aaaa", "zq", "thethe"])]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, P.PATTERN).collect()}
    assert got == {k: OWN.encode_ordinary(t) for k, t in rows}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t 1'!z你 \x1c"), max_size=40))
def test_cutting_at_blanks_keeps_the_tokens(text):
    parts = packing.chunks(text)
    assert "".join(parts) == text
    assert [x for p in parts for x in OWN.encode_ordinary(p)] == OWN.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeé nt"), min_size=1, max_size=60))
def test_heap_merges_as_the_library_does(text):
    known = bpe.ranks(RANKS)
    ids = bpe.heap_merge([known[bytes([b])] for b in text.encode()], bpe.pair_ranks(RANKS))
    assert ids == OWN._core_bpe.encode_single_piece(text.encode())


LATIN = st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \t\n'sdt.,12ab\x1c\x85\xa0")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(LATIN, st.sampled_from(["hello <|endoftext|> world", "<|endoftext|>", "你好 naïve", "a\u2009b", "İx", "'S 's"])), max_size=4))
def test_ids_are_those_of_the_tokenizer(texts):
    want = [x.ids for x in Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(FILE).ids(texts)] == want


def test_packing(awkward, empty):
    rows = packing.pack(awkward, FILE).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter()
    for d in awkward.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        for k, (s, e) in enumerate([(0, first)] + [(a, a + 2048) for a in range(first, len(ids), 2048)]):
            want[d.doc_id, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, FILE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12))
def test_plans_place_each_length_once_without_gaps(counts):
    capacity = 40
    bins: dict[int, list] = {}
    placed = Counter()
    for n, first, many, start, per, offset in packing.pack_lengths(counts, capacity):
        assert first == placed[n]
        placed[n] += many
        for k in range(many):
            bins.setdefault(start + k // per, []).append((offset + k % per * n, n))
    assert placed == Counter(counts)
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in places) <= 2
    total = sum(n * c for n, c in counts.items())
    # No two pieces above half fit one bin.
    least = max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
    assert least <= len(bins) <= 1.5 * least + 1


def test_a_hot_length_keeps_ranks_apart(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same text for all").alias("text")).repartition(7)
    rows = packing.pack(df, FILE).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 300
