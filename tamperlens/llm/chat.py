"""Chat formatting from event logs.

A log has one row per event of a message: ``open`` (with a role), ``delta`` (text
to append), ``edit`` (text that replaces all so far) and ``regenerate`` (start
again). Events are folded per message, so a long conversation is spread over
tasks; messages are rendered one by one; only digests of whole conversations
read their messages in order, one after another, and hold none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
PART = 400
LOG = "conv_id, turn, copy, seq, kind, role, text"


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|``, so that no control string is left; ``unescape`` takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def as_log(messages: DataFrame) -> DataFrame:
    """Events of finished messages (conv_id, turn, role, text): an opening and the text in parts.

    Rows with an equal turn are messages of their own, in order of role and text.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("copy", F.row_number().over(order))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / PART).cast("int")),
        lambda k: F.struct(
            (k + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"),
            F.substring(F.col("text"), k * PART + 1, F.lit(PART)).alias("text"),
        ),
    )
    first = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("open").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text"))
    return rows.withColumn("events", F.concat(F.array(first), parts)).select("conv_id", "turn", "copy", F.inline("events"))


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text): the final messages.

    Events count in order of ``seq``; of the texts, those from the last ``edit``
    or after the last ``regenerate`` on. The last role given holds. Events with
    an equal seq are taken by kind, role and text; other kinds say nothing.
    """
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    told = log.groupBy("conv_id", "turn", "copy").agg(events.alias("events"))
    resets = F.transform("events", lambda e, k: F.when(e["kind"].isin("edit", "regenerate"), k + 1).otherwise(0))
    from_here = F.slice("events", F.greatest(F.array_max(resets), F.lit(1)), F.size("events"))
    said = F.filter(from_here, lambda e: e["kind"].isin("delta", "edit"))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return told.select(
        "conv_id", "turn", "copy",
        F.coalesce(F.get(F.transform(roles, lambda e: e["role"]), F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, formatted, loss_start, loss_length): one piece of formatted text per message.

    The pieces of a conversation in order of (turn, copy) are its formatted text.
    The loss span, in code points of the piece, is an assistant's text.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK))
    body = escape(F.col("text"))
    mine = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "turn", "copy",
        F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE + "\n")).alias("formatted"),
        F.when(mine, F.length(role) + len(OPEN) + 1).alias("loss_start"),
        F.when(mine, F.length(body)).alias("loss_length"),
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """Role, text and unescaped loss text of formatted pieces."""
    inside = F.substring(F.col("formatted"), F.lit(len(OPEN) + 1), F.length("formatted") - len(OPEN) - len(CLOSE) - 1)
    at = F.instr(F.col("inside"), "\n")
    return pieces.withColumn("inside", inside).select(
        "conv_id", "turn", "copy",
        unescape(F.replace(F.substring(F.col("inside"), F.lit(1), at - 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
        unescape(F.substring(F.col("inside"), at + 1, F.length("inside"))).alias("text"),
        unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )


_KINDS = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
}


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; the state of one conversation is two hashes and three numbers."""
    done: list[list] = []
    now: list | None = None

    def finish() -> None:
        if now is not None:
            done.append([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]])

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _KINDS.values())], list(_KINDS))
        done.clear()
        return batch

    for batch in batches:
        for conv, role, text, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars"))):
            if now is None or now[0] != conv:
                finish()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss is not None:
                now[3] += len(loss)
                now[4].update(loss.encode("utf-8", "surrogatepass"))
            now[5] += chars
        if len(done) >= 1000:
            yield out()
    finish()
    if done:
        yield out()


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests, read back from the formatted pieces.

    A null role or text is empty; a null conversation is one of its own; turns
    without a number come first; repeated rows are turns of their own. An empty
    table gives an empty table; other columns are not looked at.
    """
    back = read_back(render(fold(as_log(messages))))
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "copy").mapInArrow(_digest, kinds)
