"""Pickle opcode analytics over an opcode table. Nothing is ever loaded.

``opcodes`` has ``source``, ``seq`` (0, 1, 2, ... within a source), ``pos``,
``opcode`` and ``arg``. One source may hold a large share of all rows, so what
depends on order is summed up per block of rows, and the summaries of a source
are joined by one walk over them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.functions.findings import as_findings
from tamperlens.functions.groups import capped_lists
from tamperlens.functions.ordered import WIDTH
from tamperlens.rules import markers as M

# Opcodes by what they do to the stack and the memo.
STRING_PUSH = [
    "STRING", "BINSTRING", "SHORT_BINSTRING", "UNICODE", "SHORT_BINUNICODE", "BINUNICODE",
    "BINUNICODE8",
]
MEMO_GET = ["GET", "BINGET", "LONG_BINGET"]
MEMO_PUT = ["PUT", "BINPUT", "LONG_BINPUT"]
_IMPORTS = ["GLOBAL", "STACK_GLOBAL"]


# Opcodes that move strings, name imports or call them; the rest says nothing here.
_SPEAKING = [*STRING_PUSH, *MEMO_GET, *MEMO_PUT, "MEMOIZE", *_IMPORTS, "REDUCE"]
_KEYS = ["source", "blk"]


def _blocks(opcodes: DataFrame, width: int) -> DataFrame:
    """(source, blk, ops, puts before the block, string pushed last before it): runs of opcodes, bounded in number.

    Only two small facts cross from block to block here: how many memo slots were
    filled, and whether the row in front of the block pushes a string.
    """
    # The others only stand between a string and a put.
    speaks = F.col("opcode").isin(_SPEAKING)
    op = F.struct("seq", F.when(speaks, F.col("opcode")).otherwise("").alias("opcode"), F.when(speaks, F.col("arg")).alias("arg"))
    blocks = (
        opcodes.groupBy("source", F.floor(F.col("seq") / F.lit(width)).cast("bigint").alias("blk"))
        .agg(F.array_sort(F.collect_list(op)).alias("ops"), F.count_if(F.col("opcode").isin([*MEMO_PUT, "MEMOIZE"])).alias("puts"))
    )
    last = F.element_at("ops", -1)
    before = Window.partitionBy("source").orderBy("blk")
    facts = blocks.select("source", "blk", "puts", last.alias("last")).select(
        F.col("source").alias("_source"), F.col("blk").alias("_blk"),
        F.coalesce(F.sum("puts").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("filled"),
        F.lag("last").over(before).alias("front"),
    )
    joined = blocks.join(facts, (F.col("source") == F.col("_source")) & (F.col("blk") == F.col("_blk")))
    return joined.select("source", "blk", "ops", "filled", "front")


class _Run:
    """The opcodes of one block in order, with the memo they fill. ``known`` holds strings of slots filled before."""

    def __init__(self, row: dict) -> None:
        self.ops, self.filled, self.front = row["ops"], row["filled"], row["front"]
        self.known = {m["slot"]: m["text"] for m in row.get("memo") or []}
        self.memo: dict[int, str | None] = {}

    def steps(self):
        """(opcode row, slot, string or None): a put has the slot it fills, a get the slot it reads."""
        previous, filled = self.front, self.filled
        for op in self.ops:
            name, slot = op["opcode"], None
            if name == "MEMOIZE" or name in MEMO_PUT:
                slot = filled if name == "MEMOIZE" else _integer(op["arg"])
                filled += 1
                pushed = previous is not None and previous["opcode"] in STRING_PUSH
                text = previous["arg"] if pushed else None
                if slot is not None:
                    self.memo[slot] = text
            elif name in MEMO_GET:
                slot = _integer(op["arg"])
                text = self.memo[slot] if slot in self.memo else self.known.get(slot)
            else:
                text = op["arg"]
            yield op, slot, text
            previous = op


def _integer(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def _read(batches: Iterable[pa.RecordBatch], column: str, make: Callable[[list[dict]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that ``make`` gives for some rows at a time: as many as hold ``WIDTH`` items of a list, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WIDTH, side="right")))
            # Rows without items count as well.
            stop = min(stop, at + WIDTH)
            yield make(batch.slice(at, stop - at).to_pylist())
            at = stop


def _batch(columns: list[list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))


_MEMO_KINDS = {"source": pa.string(), "blk": pa.int64(), "slot": pa.int64(), "text": pa.string(), "fills": pa.bool_()}


def _memo_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block leaves in its slots, and the slots it reads without having filled them."""

    def make(rows: list[dict]) -> pa.RecordBatch:
        out = []
        for row in rows:
            run, read = _Run(row), set()
            for op, slot, _ in run.steps():
                if op["opcode"] in MEMO_GET and slot is not None and slot not in run.memo:
                    read.add(slot)
            out += [(row["source"], row["blk"], slot, text, True) for slot, text in run.memo.items()]
            out += [(row["source"], row["blk"], slot, None, False) for slot in read]
        return _batch([list(c) for c in zip(*out)] if out else [[] for _ in _MEMO_KINDS], _MEMO_KINDS)

    return _read(batches, "ops", make)


_NAMED = "struct<seq: bigint, module: string, name: string>"
_SUMMARY = (
    f"source string, blk bigint, imports array<{_NAMED}>, calls array<struct<module: string, name: string, n: bigint>>, "
    "opening array<struct<kind: string, seq: bigint, module: string, name: string, n: bigint>>, "
    "tail array<string>, called struct<module: string, name: string>"
)
_PAIR = pa.struct([("module", pa.string()), ("name", pa.string())])
_SUMMARY_KINDS = {
    "source": pa.string(), "blk": pa.int64(),
    "imports": pa.list_(pa.struct([("seq", pa.int64()), ("module", pa.string()), ("name", pa.string())])),
    "calls": pa.list_(pa.struct([("module", pa.string()), ("name", pa.string()), ("n", pa.int64())])),
    "opening": pa.list_(pa.struct([("kind", pa.string()), ("seq", pa.int64()), ("module", pa.string()), ("name", pa.string()), ("n", pa.int64())])),
    "tail": pa.list_(pa.string()), "called": _PAIR,
}


def _summary(row: dict) -> dict:
    """Imports and calls of a block, as far as it knows them.

    While fewer than two strings were pushed in the block, an import may need
    strings from before it; until an import is known, calls may belong to one
    before it. Such events stand in ``opening``, in order: ``i`` a known import,
    ``p`` one that lacks strings (``name`` is the one string there is, ``n`` how many
    there are), ``c`` a number of calls.
    """
    strings: list[str | None] = []
    imports, opening, calls = [], [], Counter()
    current, pushed = None, 0

    def met(seq: int, module: str, name: str) -> tuple[str, str]:
        imports.append({"seq": seq, "module": module, "name": name})
        if open_:
            opening.append({"kind": "i", "seq": None, "module": module, "name": name, "n": None})
        return module, name

    for op, slot, text in _Run(row).steps():
        name, open_ = op["opcode"], pushed < 2 or current is None
        if name in STRING_PUSH or (name in MEMO_GET and text is not None):
            strings = [*strings, text][-2:]
            pushed += 1
        elif name == "GLOBAL" and text and " " in text:
            current = met(op["seq"], *text.split(" ", 1))
        elif name == "STACK_GLOBAL":
            if pushed < 2:
                opening.append({"kind": "p", "seq": op["seq"], "module": None, "name": strings[-1] if strings else None, "n": pushed})
                current = None
            elif None not in strings:
                current = met(op["seq"], *strings)
        elif name == "REDUCE":
            if not open_:
                calls[current] += 1
            elif opening and opening[-1]["kind"] == "c":
                opening[-1]["n"] += 1
            else:
                opening.append({"kind": "c", "seq": None, "module": None, "name": None, "n": 1})
    called = None if current is None else dict(zip(("module", "name"), current))
    told = [{"module": m, "name": n, "n": k} for (m, n), k in calls.items()]
    return {"source": row["source"], "blk": row["blk"], "imports": imports, "calls": told, "opening": opening, "tail": strings, "called": called}


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(rows: list[dict]) -> pa.RecordBatch:
        made = [_summary(row) for row in rows]
        return _batch([[m[c] for m in made] for c in _SUMMARY_KINDS], _SUMMARY_KINDS)

    return _read(batches, "ops", make)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events that wait for earlier blocks, resolved by one walk over the summaries of a source."""
    kinds = {c: _SUMMARY_KINDS[c] for c in ("source", "imports", "calls")}

    def walked(row: dict) -> tuple:
        strings: list[str | None] = []
        current, found, calls = None, [], Counter()
        for block in row["blocks"]:
            for event in block["opening"]:
                if event["kind"] == "i":
                    current = event["module"], event["name"]
                elif event["kind"] == "p":
                    pair = [*strings, *[event["name"]] * min(event["n"], 1)][-2:]
                    if len(pair) == 2 and None not in pair:
                        current = tuple(pair)
                        found.append({"seq": event["seq"], "module": pair[0], "name": pair[1]})
                elif current is not None:
                    calls[current] += event["n"]
            strings = [*strings, *block["tail"]][-2:]
            if block["called"]:
                current = block["called"]["module"], block["called"]["name"]
        return row["source"], found, [{"module": m, "name": n, "n": k} for (m, n), k in calls.items()]

    return _read(batches, "blocks", lambda rows: _batch([list(c) for c in zip(*map(walked, rows))], kinds))


def block_summaries(opcodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(source, imports, calls): imports in order of naming, and how often each is called, over blocks and over sources.

    Blocks of a source are read apart. Strings that a block reads from memo slots it
    did not fill come from the last block before it that did; what else depends on
    earlier blocks is settled by one walk over a row per block.
    """
    blocks = _blocks(opcodes, width)
    memo = blocks.mapInArrow(_memo_rows, "source string, blk bigint, slot bigint, text string, fills boolean")
    before = Window.partitionBy("source", "slot").orderBy("blk", "fills").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("fills"), F.struct("text")), ignorenulls=True).over(before)
    read = memo.withColumn("latest", latest).where(~F.col("fills") & F.col("latest.text").isNotNull())
    known = read.groupBy(F.col("source").alias("_source"), F.col("blk").alias("_blk")).agg(F.collect_list(F.struct("slot", F.col("latest.text").alias("text"))).alias("memo"))
    with_memo = blocks.join(known, (F.col("source") == F.col("_source")) & (F.col("blk") == F.col("_blk")), "left")
    summaries = with_memo.select("source", "blk", "ops", "filled", "front", "memo").mapInArrow(_summaries, _SUMMARY)
    told = summaries.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("blk", "opening", "tail", "called"))).alias("blocks"))
    settled = told.mapInArrow(_joined, f"source string, imports array<{_NAMED}>, calls array<struct<module: string, name: string, n: bigint>>")
    return summaries.select("source", "imports", "calls").unionByName(settled)


def imports(opcodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(source, seq, module, name) of GLOBAL and STACK_GLOBAL.

    A STACK_GLOBAL takes the last two strings pushed before it. A put stores the
    string pushed by the row before it; a get pushes the latest string stored
    under its slot, so a slot that is written twice is read as the interpreter
    would read it.
    """
    return block_summaries(opcodes, width).select("source", F.inline("imports"))


def triage_imports(contents: DataFrame) -> DataFrame:
    """GLOBAL imports straight from the bytes, without disassembly.

    Fast and coarse: for choosing which files to disassemble.
    """
    text = B.latin1(F.col("content"))
    lines = F.regexp_extract_all(text, F.lit(r"c([A-Za-z_][A-Za-z0-9_.]*)\n([A-Za-z_][A-Za-z0-9_.]*)\n"), 0)
    return contents.select(
        F.col("path").alias("source"), F.explode(F.array_distinct(lines)).alias("line")
    ).select(
        "source",
        F.regexp_extract("line", r"c([^\n]*)\n", 1).alias("module"),
        F.regexp_extract("line", r"\n([^\n]*)\n", 1).alias("name"),
    )


def dangerous_opcodes(opcodes: DataFrame) -> DataFrame:
    """(source, opcodes): the distinct opcodes, of eight possible, that import, call or build."""
    return (
        opcodes.where(F.col("opcode").isin(M.DANGEROUS_OPCODES))
        .groupBy("source")
        .agg(F.array_sort(F.collect_set("opcode")).alias("opcodes"))
    )


def _pair(module, name):
    return F.concat(module, F.lit("."), name)


def _is_listed():
    listed = [f"{module}.{name}" for module, name in M.DANGEROUS_IMPORTS]
    return _pair(F.col("module"), F.col("name")).isin(listed)


def is_dangerous():
    evaluator = F.col("module").isin(M.BUILTIN_MODULES) & F.col("name").isin(M.BUILTIN_EVALUATORS)
    return _is_listed() | evaluator


def dangerous_imports(imports: DataFrame) -> DataFrame:
    return imports.where(is_dangerous())


def suspicious_imports(imports: DataFrame) -> DataFrame:
    """Imports of suspicious modules that are not on the dangerous list."""
    return imports.where(F.col("module").isin(M.SUSPICIOUS_MODULES) & ~_is_listed())


def opcode_counts(opcodes: DataFrame) -> DataFrame:
    return opcodes.groupBy("source").agg(
        F.count_if(F.col("opcode") == "REDUCE").alias("reduces"),
        F.count_if(F.col("opcode").isin(_IMPORTS)).alias("globals"),
    )


def text_marks(contents: DataFrame) -> DataFrame:
    """(source, base64, evaluator) flags of the raw bytes."""
    text = B.latin1(F.col("content"))
    return contents.select(
        F.col("path").alias("source"),
        F.contains(F.lower(text), F.lit("base64")).alias("base64"),
        (F.contains(text, F.lit("eval(")) | F.contains(text, F.lit("exec("))).alias("evaluator"),
    )


def opcode_text_marks(opcodes: DataFrame) -> DataFrame:
    """The same flags from the arguments in an opcode table."""
    return opcodes.groupBy("source").agg(
        F.bool_or(F.contains(F.lower(F.coalesce("arg", F.lit(""))), F.lit("base64"))).alias("base64"),
        F.bool_or(
            F.contains(F.coalesce("arg", F.lit("")), F.lit("eval("))
            | F.contains(F.coalesce("arg", F.lit("")), F.lit("exec("))
        ).alias("evaluator"),
    )


def obfuscation(counts: DataFrame, marks: DataFrame) -> DataFrame:
    """(source, reasons) for sources that hide what they do."""
    joined = counts.join(marks, "source", "full_outer")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("reduces") > 10, F.concat(F.lit("REDUCE opcodes: "), F.col("reduces").cast("string"))),
            F.when(F.col("globals") > 20, F.concat(F.lit("GLOBAL imports: "), F.col("globals").cast("string"))),
            F.when(F.col("base64"), F.lit("base64 mentioned")),
            F.when(F.col("evaluator"), F.lit("eval/exec text")),
        )
    )
    return joined.select("source", reasons.alias("reasons")).where(F.size("reasons") > 0)


def _judged(found: DataFrame) -> DataFrame:
    """(source, dangerous, n_dangerous, suspicious, n_suspicious): named imports per source.

    Both kinds are counted in one pass; 100 names are listed, the counts are of all.
    """
    kind = F.when(is_dangerous(), "dangerous").when(F.col("module").isin(M.SUSPICIOUS_MODULES), "suspicious")
    rows = found.withColumn("kind", kind).where(F.col("kind").isNotNull())
    lists = capped_lists(rows, ["source", "kind"], _pair(F.col("module"), F.col("name")), 100, "names", "n", "d")
    pick = lambda name, column: F.max(F.when(F.col("kind") == name, F.col(column)))
    return lists.groupBy("source").agg(
        pick("dangerous", "names").alias("dangerous"), pick("dangerous", "n").alias("n_dangerous"),
        pick("suspicious", "names").alias("suspicious"), pick("suspicious", "n").alias("n_suspicious"),
    )


def verdicts(opcodes: DataFrame, marks: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """One import verdict per source, and an obfuscation finding beside it.

    ``marks`` and ``found`` stand in for the flags and imports of the opcode table.
    """
    found = imports(opcodes) if found is None else found
    marks = opcode_text_marks(opcodes) if marks is None else marks
    per_source = (
        dangerous_opcodes(opcodes)
        .join(_judged(found), "source")
        .withColumn("path", F.col("source"))
    )
    critical = F.col("n_dangerous") > 0
    high = ~F.coalesce(critical, F.lit(False)) & (F.col("n_suspicious") > 0)
    judged = as_findings(
        per_source.where(critical | high),
        "pickle",
        F.when(
            critical, "Pickle Exploit Payload - Code Execution Imports (targets pickle.load())"
        ).otherwise("Pickle Suspicious Payload - Review Required (potential pickle.load() exploit)"),
        F.when(critical, "Critical").otherwise("High"),
        F.when(critical, 9.8).otherwise(7.5),
        F.concat(
            F.lit("Imports: "), F.array_join(F.when(critical, F.col("dangerous")).otherwise(F.col("suspicious")), ", ")
        ),
        evidence={
            "imports": F.array_join(F.when(critical, F.col("dangerous")).otherwise(F.col("suspicious")), ","),
            "opcodes": F.array_join("opcodes", ","),
        },
        advice="Do not unpickle; ask for safetensors or ONNX.",
        references=["https://research.jfrog.com/model-threats/pickle-malcode/"],
        cwe="CWE-502",
    )
    hidden = as_findings(
        obfuscation(opcode_counts(opcodes), marks).withColumn("path", F.col("source")),
        "pickle",
        "Pickle Deserialization - Obfuscation Detected",
        "Medium",
        5.5,
        F.concat(F.lit("Signs of obfuscation: "), F.array_join("reasons", ", ")),
        evidence={"imports": F.lit(None).cast("string"), "opcodes": F.array_join("reasons", ",")},
        advice="Find out what the pickle hides.",
        cwe="CWE-502",
    )
    return judged.unionByName(hidden)


def call_summary(opcodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(source, call, calls): dangerous callables whose import a REDUCE follows.

    Each REDUCE is taken to call the latest import before it in its source.
    """
    called = block_summaries(opcodes, width).select("source", F.inline("calls"))
    dangerous = F.col("module").isin(M.CALL_MODULES) | F.col("name").isin(M.CALL_FUNCTIONS)
    return called.where(dangerous).groupBy("source", _pair(F.col("module"), F.col("name")).alias("call")).agg(F.sum("n").alias("calls"))
