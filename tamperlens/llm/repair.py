"""Repair of conversation structure by a checkpointed shortest path over edits.

A row is kept, given another role, deleted, or something is inserted before it,
so that the roles read system?, (user, assistant)+ or nothing at all. Four
states say what came last; a backward pass gives each row the least cost from
every state, and a forward walk takes, of the edits that are tight, the
ASCII-least.

Vectors are kept at checkpoints alone. Conversations are cut into blocks of about
the square root of the longest one. Each block is summed up as a 4 x 4 table of
costs; one pass per conversation over those tables gives the vectors at the
checkpoints, one over the blocks' walks gives the states there, and each block
recomputes its inner vectors and walks forward on its own. So a conversation of
any length is spread over tasks, and only one row per block meets in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.common import stored

# A block has so many rows at least.
LEAST_WIDTH = 16
_FAR = 2**60
# States: nothing yet, after system, after user, after assistant. What an inserted or re-roled row leads to:
_NEXT = (2, 2, 3, 2)
_SAYS = ("user", "user", "assistant", "user")
# The state after a kept row by its role's initial (system, user, assistant, other); -1: it cannot stay there.
_KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
# Least cost to end from each state, with nothing but insertions.
_END = (0, 6, 3, 0)
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
_PAIRS = {(0, 1), (1, 2), (2, 1)}
_GAP = r"[\x20\x09-\x0D]"


def symbol(initial: int, fault: int) -> str:
    return chr(ord("A") + 4 * initial + fault)


def _read(code: str) -> tuple[int, int]:
    return divmod(ord(code) - ord("A"), 4)


@lru_cache(200_000)
def step(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs before a row, insertions included, out of those behind it."""
    initial, fault = _read(code)
    own = []
    for state in range(4):
        best = after[state] + 4
        if fault < BLANK:
            best = min(best, after[_NEXT[state]] + 3 + 3 * fault)
            if (to := _KEPT[initial][state]) >= 0:
                best = min(best, after[to] + 3 * fault)
        own.append(best)
    user, assistant = min(own[2], own[3] + 3), min(own[3], own[2] + 3)
    return min(own[0], user + 3), min(own[1], user + 3), user, assistant


def vectors(codes: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs before each row of a block, and at its end."""
    out = [end]
    for code in reversed(codes):
        low = min(out[-1])
        # Counted from the least one: the same vectors recur.
        out.append(tuple(x + low for x in step(code, tuple(x - low for x in out[-1]))))
    return out[::-1]


@lru_cache(50_000)
def table(codes: str) -> tuple[tuple[int, ...], ...]:
    """Cost from each state before a block to each state behind its last row."""
    ends = [vectors(codes, tuple(0 if k == to else _FAR for k in range(4)))[0] for to in range(4)]
    return tuple(zip(*ends))


def walk(codes: str, before: list[tuple[int, ...]], state: int, last: bool) -> tuple[list[tuple[int, str, str | None]], int]:
    """(row, edit, role given) of the ASCII-least tight edits from a state, and the state behind the block."""
    edits: list[tuple[int, str, str | None]] = []
    at = 0
    while at < len(codes) or (last and before[at][state]):
        cost = before[at][state]
        if at < len(codes):
            after, (initial, fault) = before[at + 1], _read(codes[at])
            if after[state] + 4 == cost:
                edits.append((at, "D", None))
                at += 1
                continue
        if before[at][_NEXT[state]] + 3 == cost:
            edits.append((at, "I", _SAYS[state]))
            state = _NEXT[state]
            continue
        to = _KEPT[initial][state]
        if to >= 0 and after[to] + 3 * fault == cost:
            edits.append((at, "K", None))
            state = to
        else:
            edits.append((at, "R", _SAYS[state]))
            state = _NEXT[state]
        at += 1
    return edits, state


@lru_cache(50_000)
def _ends(codes: str, end: tuple[int, ...]) -> tuple[int, ...]:
    before = vectors(codes, end)
    return tuple(walk(codes, before, state, False)[1] for state in range(4))


def _rows(batches: Iterable[pa.RecordBatch], make: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Turn each input row (a dict) into an output row (a tuple)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            out = [make(row) for row in batch.slice(lo, 1000).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _relative(vector: Iterable[int]) -> tuple[int, ...]:
    low = min(vector)
    return tuple(x - low for x in vector)


_TABLES = pa.schema([
    ("conv_id", pa.int64()), ("blk", pa.int64()), ("costs", pa.list_(pa.list_(pa.int64()))), ("head", pa.int32()), ("tail", pa.int32()),
    ("illegal", pa.int64()), ("faults", pa.list_(pa.int64())),
])


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(row: dict) -> tuple:
        read = [_read(c) for c in row["codes"]]
        wrong = sum((a[0], b[0]) not in _PAIRS for a, b in zip(read, read[1:]))
        faults = [sum(f == kind for _, f in read) for kind in (BLANK, DUPLICATE, TRUNCATED)]
        return row["conv_id"], row["blk"], table(row["codes"]), read[0][0], read[-1][0], wrong, faults

    return _rows(batches, make, _TABLES)


_TOTALS = pa.schema([
    ("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("blks", pa.list_(pa.int64())), ("ends", pa.list_(pa.list_(pa.int64()))),
])


def _checkpoints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: the vector behind each block (relative to its least cost), and totals."""

    def make(row: dict) -> tuple:
        blocks = row["blocks"]
        vector, ends = _END, []
        for b in reversed(blocks):
            ends.append(_relative(vector))
            vector = tuple(min(cost + v for cost, v in zip(costs, vector)) for costs in b["costs"])
        wrong = sum(b["illegal"] for b in blocks) + sum((a["tail"], b["head"]) not in _PAIRS for a, b in zip(blocks, blocks[1:]))
        faults = [sum(x) for x in zip(*(b["faults"] for b in blocks))]
        return row["conv_id"], *faults, wrong, vector[0], [b["blk"] for b in blocks], ends[::-1]

    return _rows(batches, make, _TOTALS)


_LEADS = pa.schema([("conv_id", pa.int64()), ("blk", pa.int64()), ("leads", pa.list_(pa.int32()))])


def _block_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State behind a block for each state before it."""
    return _rows(batches, lambda r: (r["conv_id"], r["blk"], _ends(r["codes"], tuple(r["end"]))), _LEADS)


_STARTS = pa.schema([("conv_id", pa.int64()), ("blks", pa.list_(pa.int64())), ("states", pa.list_(pa.int32()))])


def _starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before each block of a conversation."""

    def make(row: dict) -> tuple:
        state, states = 0, []
        for b in row["blocks"]:
            states.append(state)
            state = b["leads"][state]
        return row["conv_id"], [b["blk"] for b in row["blocks"]], states

    return _rows(batches, make, _STARTS)


_EDITS = pa.schema([
    ("conv_id", pa.int64()), ("blk", pa.int64()), ("audit", pa.string()),
    ("edits", pa.list_(pa.struct([("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string())]))),
])


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recompute the vectors of a block and walk through it."""

    def make(row: dict) -> tuple:
        before = vectors(row["codes"], tuple(row["end"]))
        found, _ = walk(row["codes"], before, row["state"], row["last"])
        return row["conv_id"], row["blk"], "".join(e for _, e, _ in found), [{"pos": row["first"] + at, "edit": e, "role": r} for at, e, r in found]

    return _rows(batches, make, _EDITS)


def _sql(schema: pa.Schema) -> str:
    def name(kind: pa.DataType) -> str:
        if pa.types.is_list(kind):
            return f"array<{name(kind.value_type)}>"
        if pa.types.is_struct(kind):
            return "struct<" + ", ".join(f"{f.name}: {name(f.type)}" for f in kind) + ">"
        return {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}[kind]

    return ", ".join(f"{f.name} {name(f.type)}" for f in schema)


def _gathered(df: DataFrame, *columns: str) -> DataFrame:
    """One row per conversation, with its blocks in order."""
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("blk", *columns))).alias("blocks"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"])


def damage(messages: DataFrame) -> DataFrame:
    """Drop, empty, cut, repeat and re-role rows by a checksum of their place; nulls read as one blank."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (
        messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind"))
        .where("_kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def in_order(messages: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, role, text, digest): rows numbered by conversation, turn (nulls first), role and text digest.

    Ranges of the order go to tasks, so a long conversation spans several; rows
    that are equal throughout are told apart by where they were read.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumns({"digest": F.sha2(F.col("text").cast("binary"), 256), "_read": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "digest", "_read"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text", "digest"), "turns")


def coded(ordered: DataFrame, width: int) -> DataFrame:
    """(conv_id, blk, first, codes): blocks of rows, each row a symbol of its role's initial and first fault."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{_GAP}*\z")
    rows = ordered.select("pos", "conv_id", "role", "digest", F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(CLEAN).alias("fault"))
    heads = (
        rows.where(F.col("fault") != BLANK)
        .groupBy("conv_id", F.col("role").alias("_role"), F.col("digest").alias("_digest"))
        .agg(F.min("pos").alias("_head"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .withColumnRenamed("conv_id", "_conv")
    )
    again = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")) & (F.col("pos") > F.col("_head"))
    marked = rows.join(heads, again, "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("_head").isNotNull(), DUPLICATE).otherwise(F.col("fault"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.char(F.lit(ord("A")) + 4 * kind + fault)
    block = F.shiftright("pos", int(log2(width)))
    gathered = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"))))
    return marked.groupBy("conv_id", block.alias("blk")).agg(F.min("pos").alias("first"), F.array_join(F.transform(gathered, lambda x: x["code"]), "").alias("codes"))


def plan(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals per conversation, and per block its audit and edits (pos, edit, role)."""
    longest = ordered.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    width = max(LEAST_WIDTH, 2 ** ceil(log2(longest) / 2))
    blocks = stored(coded(ordered, width), "blocks")
    tables = blocks.mapInArrow(_tables, _sql(_TABLES))
    totals = stored(_gathered(tables, "costs", "head", "tail", "illegal", "faults").mapInArrow(_checkpoints, _sql(_TOTALS)), "checkpoints")
    ends = totals.select(
        F.col("conv_id").alias("_conv"), F.element_at("blks", -1).alias("_last"), F.inline(F.arrays_zip(F.col("blks").alias("_blk"), F.col("ends").alias("end")))
    )
    here = blocks["conv_id"].eqNullSafe(ends["_conv"]) & (blocks["blk"] == ends["_blk"])
    known = stored(blocks.join(ends, here).select("conv_id", "blk", "first", "codes", "end", (F.col("blk") == F.col("_last")).alias("last")), "ends")
    leads = known.select("conv_id", "blk", "codes", "end").mapInArrow(_block_ends, _sql(_LEADS))
    starts = _gathered(leads, "leads").mapInArrow(_starts, _sql(_STARTS)).select(
        F.col("conv_id").alias("_conv"), F.inline(F.arrays_zip(F.col("blks").alias("_blk"), F.col("states").alias("state")))
    )
    there = known["conv_id"].eqNullSafe(starts["_conv"]) & (known["blk"] == starts["_blk"])
    walks = known.join(starts, there).select(*known.columns, "state").mapInArrow(_edits, _sql(_EDITS))
    return totals.drop("blks", "ends"), stored(walks, "edits")


def repaired(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, blk, k, edit, role, text): the repaired messages, in order of (blk, k) within a conversation."""
    each = edits.select("conv_id", "blk", F.posexplode("edits").alias("k", "e")).select("conv_id", "blk", "k", "e.*")
    old = ordered.select("pos", F.col("role").alias("_role"), "text")
    stay = each.where("edit in ('K', 'R')").join(old, "pos").select("conv_id", "blk", "k", "edit", F.coalesce("role", "_role").alias("role"), "text")
    return stay.unionByName(each.where("edit = 'I'").select("conv_id", "blk", "k", "edit", "role", F.lit("").alias("text")))


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; of each conversation only the hash of what was read is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, hashed, done = None, None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if hashed is None or conv != now:
                if hashed is not None:
                    done.append((now, hashed.hexdigest()))
                now, hashed = conv, hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if hashed is not None:
        done.append((now, hashed.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def report(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults, cost, audit and digest of the repaired ``messages``.

    Rows count by turn, nulls first, then by role and text digest; a null role or
    text is one blank, a null conversation one of its own. A conversation
    without messages has zeros, an empty audit and the digest of nothing. Repeated
    rows are duplicates of the first; texts may have any length. Empty tables
    give an empty table; other columns are not looked at.
    """
    ordered = in_order(messages)
    totals, edits = plan(ordered)
    turns = ordered.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    audits = _gathered(edits, "audit").select("conv_id", F.array_join(F.transform("blocks", lambda b: b["audit"]), "").alias("audit"))
    final = repaired(ordered, edits).repartition("conv_id").sortWithinPartitions("conv_id", "blk", "k").select("conv_id", "role", "text")
    hashes = final.mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (named, totals, turns, audits, hashes)).groupBy("conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = together.agg(*(F.max(c).alias(c) for c in (*numbers, "audit", "repaired_sha256")))
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
