"""Pickle opcodes in blocks of any width against one walk over all of them."""

from __future__ import annotations

import random

import pytest

from tamperlens.operators import pickles
from tamperlens.operators.pickles import MEMO_GET, MEMO_PUT, STRING_PUSH


def walk(ops):
    """Imports and calls of one source, opcode after opcode."""
    memo, filled, strings, found, calls, current, previous = {}, 0, [], [], {}, None, None
    for seq, (name, arg) in enumerate(ops):
        if name in STRING_PUSH:
            strings.append(arg)
        elif name == "MEMOIZE" or name in MEMO_PUT:
            memo[filled if name == "MEMOIZE" else int(arg)] = previous[1] if previous and previous[0] in STRING_PUSH else None
            filled += 1
        elif name in MEMO_GET and memo.get(int(arg)) is not None:
            strings.append(memo[int(arg)])
        elif name == "GLOBAL" and " " in arg:
            current = tuple(arg.split(" ", 1))
            found.append((seq, *current))
        elif name == "STACK_GLOBAL" and len(strings) > 1 and None not in strings[-2:]:
            current = tuple(strings[-2:])
            found.append((seq, *current))
        elif name == "REDUCE" and current:
            calls[current] = calls.get(current, 0) + 1
        previous = name, arg
    return found, calls


def made(seed, n):
    r = random.Random(seed)
    pick = [
        lambda: ("SHORT_BINUNICODE", r.choice(["os", "system", "posix", "x", "eval", None])), lambda: ("SHORT_BINUNICODE", r.choice(["os", "system"])),
        lambda: ("MEMOIZE", None), lambda: ("BINPUT", str(r.randrange(12))), lambda: ("BINGET", str(r.randrange(14))), lambda: ("BINGET", str(r.randrange(14))),
        lambda: ("STACK_GLOBAL", None), lambda: ("STACK_GLOBAL", None), lambda: ("GLOBAL", r.choice(["os system", "nospace", "a b c"])), lambda: ("REDUCE", None),
        lambda: ("REDUCE", None), lambda: ("MARK", None), lambda: ("BININT1", "5"),
    ]
    return [r.choice(pick)() for _ in range(n)]


@pytest.mark.parametrize("width", [1, 3, 16, 65_536])
def test_blocks_split_anywhere(spark, width):
    sources = {f"s{k}": made(k, 4 + 13 * (k % 9)) for k in range(30)}
    # Numbers of rows rise, but need not be next to each other.
    step = 1 if width < 16 else 7
    rows = [(s, seq * step, seq, name, arg) for s, ops in sources.items() for seq, (name, arg) in enumerate(ops)]
    table = spark.createDataFrame(rows, "source string, seq long, pos long, opcode string, arg string").repartition(3)
    got = sorted(tuple(r) for r in pickles.imports(table, width).collect())
    assert got == sorted((s, seq * step, *pair) for s, ops in sources.items() for seq, *pair in walk(ops)[0])
    calls = pickles.block_summaries(table, width).selectExpr("source", "inline(calls)").groupBy("source", "module", "name").sum("n").collect()
    assert sorted(tuple(r) for r in calls) == sorted((s, *pair, n) for s, ops in sources.items() for pair, n in walk(ops)[1].items())


def test_no_more_than_six_shuffles(spark):
    table = spark.createDataFrame([("s", 0, 0, "GLOBAL", "os system")], "source string, seq long, pos long, opcode string, arg string")
    plan = pickles.imports(table)._jdf.queryExecution().executedPlan().toString()
    # Before reuse, a subtree that is used twice is listed twice: shuffles are told apart by what they deal out.
    dealt = {line[line.index("hashpartitioning") :].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line}
    assert len(dealt) <= 6
