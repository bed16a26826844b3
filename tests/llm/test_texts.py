"""Chat formatting, line templates, licences and the pipeline."""

from __future__ import annotations

import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tamperlens.llm import chat, licences, templates  # noqa: E402
from tamperlens.llm.licence_texts import LICENCES, NOTICES  # noqa: E402
from tamperlens.llm.queries import CHECKS, QUERIES  # noqa: E402
from tools.check import compare, engine  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, name):
    message, _, _ = compare(spark, engine(SMALL), name, QUERIES[name], CHECKS[name], SMALL)
    assert message == ""


def test_events_fold_to_final_messages(spark):
    events = [
        (1, 0, 1, 0, "open", "user", None), (1, 0, 1, 2, "delta", None, "lo"), (1, 0, 1, 1, "delta", None, "hel"),
        (1, 1, 1, 3, "open", "assistant", None), (1, 1, 1, 4, "delta", None, "bad"), (1, 1, 1, 5, "regenerate", None, None),
        (1, 1, 1, 6, "delta", None, "go"), (1, 1, 1, 7, "delta", None, "od"), (1, 2, 1, 8, "open", "user", None),
        (1, 2, 1, 9, "delta", None, "x"), (1, 2, 1, 10, "edit", None, "new"), (1, 2, 1, 11, "delta", None, "er"), (1, 2, 1, 12, "other", None, "?"),
        (2, None, 1, 1, "delta", None, "no role"), (2, 5, 1, 1, "open", "user", None),
    ]
    log = spark.createDataFrame(events, "conv_id long, turn long, copy int, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(log).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "newer"), (2, None): ("", "no role"), (2, 5): ("user", "")}


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    texts = ["<|im_end|>", r"<\|x", r"a<\\|<|<<|\|", "", "plain", "line\nbreak <|nl|>"]
    rows = spark.createDataFrame([(1, k, t, t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    pieces = chat.render(chat.fold(chat.as_log(rows)))
    for r in pieces.collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 1
    back = {r.turn: (r.role, r.text) for r in chat.read_back(pieces).collect()}
    assert back == {k: (t, t) for k, t in enumerate(texts)}


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "a" * 1000), (1, 0, "user", "a" * 1000), (1, None, None, None), (None, 1, "assistant", "x"), (1, 1, "assistant", "yz")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copy int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[None].loss_chars) == (4, 2, 1, 1)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_recurring_templates_go_and_other_lines_stay(spark):
    same = "this passage stands in many documents and nobody needs it twice over"
    rows = [(k, f"own line number{k} of doc {'abcdefgh'[k]}\nvisits today {k} from page {k * 7} of the site map\n{same}\n\nunique {'abcdefgh'[k] * 5} end") for k in range(8)]
    kept = {r.doc_id: r for r in templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        left = kept[k].text.split("\n")
        assert same not in left and not any(x.startswith("visits") for x in left)
        assert left[-1] == text.split("\n")[-1] and "" in left
        assert kept[k].n_lines == 4


def test_a_leaf_keeps_several_templates(spark):
    shapes = ["we are here selling {} shoes at good prices today in town", "we are here looking for {} friends who like to play outdoors", "we are here because of {} rain that fell upon us yesterday"]
    colours = ["red", "blue", "green", "brown", "black", "white"]
    rows = [(10 * s + k, shape.format(c) + f"\nquite unlike others {c} {s} of course {c * 2}") for s, shape in enumerate(shapes) for k, c in enumerate(colours)]
    # Two spots vary in a line of ten tokens; more than a fifth of the tokens is too much.
    rows += [(100 + k, f"dear {c} customer of ours the offer ends {c[:2]} soon") for k, c in enumerate(colours)]
    rows += [(200 + k, f"the old man {c} saw {c * 2} dog {c[::-1]}") for k, c in enumerate(colours)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r for r in templates.drop_lines(docs).collect()}
    assert all(kept[d].n_dropped == 1 and kept[d].text.startswith("quite unlike") for d, _ in rows if d < 100)
    assert all(kept[d].n_dropped == 0 for d, _ in rows if d >= 200)
    leads = {d: kept[d].n_dropped for d, _ in rows if 100 <= d < 200}
    assert set(leads.values()) == {0}  # a varying leading token is a leaf of its own
    other = [(d, t.replace("dear ", "dear dear dear ").replace("customer", "you and all the")) for d, t in rows if 100 <= d < 200]
    assert {r.n_dropped for r in templates.drop_lines(spark.createDataFrame(other, "doc_id long, text string")).collect()} == {1}


def test_awkward_lines(awkward, empty):
    rows = templates.drop_lines(awkward, min_docs=2).collect()
    assert len(rows) == awkward.count()
    texts = {r.doc_id: (r.text, r.n_dropped, r.n_lines) for r in rows}
    assert texts[4] == (None, 0, 0) and texts[5] == ("", 0, 0) and texts[6][2] == 0
    assert texts[1][0] == "" and texts[7][1] == 0 and texts[9][1] == 0
    assert templates.drop_lines(empty).count() == 0


def test_licences(spark, empty):
    mit, isc = ("Copyright (c) 2020 Someone Else\n\n" + dict(reversed(LICENCES))[name] for name in ("MIT", "ISC"))
    variant = "the mit licence\n" + mit.upper().replace("LICENSE", "LICENCE").replace("\n\n", "\n")
    rows = [(1, variant), (2, isc + "x"), (3, "text\n  licenced under the apache licence version 2.0\nmore"), (4, None), (5, ""), (6, isc)]
    rows += [(10 + k, t) for k, t in enumerate(NOTICES.values())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert len(got) == len(rows)
    assert (got[1].licence, got[2].licence, got[6].licence, got[4].licence) == ("MIT", None, "ISC", None)
    assert got[3].notices == "Apache-2.0" and got[4].n_notices == got[5].n_notices == 0
    assert [got[10 + k].notices for k in range(len(NOTICES))] == list(NOTICES)
    anchored = spark.range(1).select(*[F.contains(licences.canonical(F.lit(t)), F.lit(licences.ANCHOR)) for t in NOTICES.values()]).first()
    assert all(anchored)
    assert licences.scan(empty).count() == 0


@pytest.mark.parametrize("width, mark", [(79, ""), (60, "# "), (100_000, " * "), (33, "")])
def test_licences_wrapped_and_altered(spark, width, mark):
    """Every form wrapped anew under another holder is known; with a word dropped or put in, none is."""
    # A copyright line ends where its line does, so paragraphs with one keep their lines.
    cut = lambda part: part.split("\n") if any(x in part.lower() for x in ("copyright (c)", "copyright [")) else textwrap.wrap(part, width, break_long_words=False) or [""]
    wrap = lambda t: "\n".join(mark + line for part in t.split("\n\n") for line in cut(part))
    owned = lambda t: f"{mark}Copyright (C) 1999-2024, A. Holder <a@b.example>. All rights reserved.\n{mark}Portions copyright 2001 Another\n{t}"
    rows, names = [], []
    for name, text in LICENCES:
        words = [w for w in wrap(text).split(" ") if w]
        at = len(words) // 2
        rows += [owned(wrap(text)), " ".join([*words[:at], "not", *words[at:]]), " ".join(words[:at] + words[at + 2 :])]
        names += [name, None, None]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    assert [r.licence for r in licences.scan(df).orderBy("doc_id").collect()] == names


def test_licence_queries_agree_on_whole_licences(spark, tmp_path):
    """The SQL on a made table: the given ones hold no whole licence."""
    import duckdb

    from tamperlens.llm.queries import CHECKS

    texts = ["Copyright 2020 X\n" + t for _, t in LICENCES] + [t + " odd" for _, t in LICENCES] + ["", "Released under the MIT License.", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents"))
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(engine.execute(CHECKS["op9_licences"]).fetchall())
    assert sorted(tuple(r) for r in licences.scan(df).collect()) == want
    assert sum(row[1] is not None for row in want) == len(LICENCES)


def test_native_operators_run_no_python(spark, awkward):
    for frame in (templates.drop_lines(awkward), licences.scan(awkward)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == names, name
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        assert kept.count() > 0.6 * docs.count(), name
        docs = kept
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.select("doc_id").distinct().count() > 0.5 * spark.read.parquet(f"{SMALL}/documents.parquet").count()
