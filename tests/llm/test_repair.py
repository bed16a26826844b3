"""Conversation repair against a plain recursion over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tamperlens.llm import repair

SHAPE = "conv_id long, turn long, role string, text string, pos int, digest string, blk int, codes string, audit string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """The report of one conversation's rows (turn, role, text), by recursion over every edit."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(at, last, inserts=0):
        options = []
        if at == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if at < len(rows):
            _, role, text = rows[at]
            cost, audit, said = best(at + 1, last)
            options.append((cost + 4, "D" + audit, said))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                if (last, role[:1]) in moves:
                    cost, audit, said = best(at + 1, role[:1])
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *said)))
                for other in ("user", "assistant"):
                    if (last, other[0]) in moves:
                        cost, audit, said = best(at + 1, other[0])
                        options.append((cost + more + 3, "R" + audit, (f"{other}:{text}", *said)))
        if inserts < 3:
            for other in ("user", "assistant"):
                if (last, other[0]) in moves:
                    found = best(at, other[0], inserts + 1)
                    if found:
                        options.append((found[0] + 3, "I" + found[1], (f"{other}:", *found[2])))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    cost, audit, said = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, sha("\n".join(said)),
    )


def made(seed, n):
    r = random.Random(seed)
    texts = ["Fine.", "Is it?", "cut off", "", " \t", "Yes! \n", "é", "one. two"]
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant"]
    return [(r.choice([None, k // 2, k]), r.choice(roles), r.choice([*texts, f"number {k}.", f"open {k}", None])) for k in range(n)]


def check(spark, conversations):
    rows = [(c, *row, 1, "x", 2, "y", "z") for c, rs in conversations.items() for row in rs]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(df, df).collect()}
    assert got == {c: plain(rs) for c, rs in conversations.items()}


def test_many_short_conversations_and_null_ids(spark):
    check(spark, {k or None: made(k, k % 9 + 1) for k in range(120)})


@pytest.mark.parametrize("width", [2, 16])
def test_blocks_meet_without_a_seam(spark, monkeypatch, width):
    monkeypatch.setattr(repair, "LEAST_WIDTH", width)
    alike = [(None, "user", "same.")] * 40
    check(spark, {1: made(1, 300), 2: made(2, 31), 3: alike, 4: [(k, "assistant" if k % 2 else "user", f"turn {k}.") for k in range(200)]})


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(60) for t in range(4)]
    rows += [(None, None, None, None), (77, None, "user", "a?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [] if kind == 0 else [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, repair.damage(df).collect()), key=key) == sorted(want, key=key)
    gone = repair.report(df.limit(0), df).collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", sha(""))} and len(gone) == 62
    assert repair.report(df.limit(0), df.limit(0)).count() == 0


def test_tables_of_blocks_compose():
    r = random.Random(5)
    codes = "".join(repair.symbol(r.randrange(4), r.randrange(4)) for _ in range(40))
    whole = repair.vectors(codes, repair._END)[0]
    end = repair._END
    for part in (codes[25:], codes[7:25], codes[:7]):
        end = tuple(min(c + v for c, v in zip(costs, end)) for costs in repair.table(part))
    assert end == whole
