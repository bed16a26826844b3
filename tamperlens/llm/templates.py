"""Line de-duplication by a tree of line templates, in DataFrame operations only.

A line is parsed to tokens; tokens with a digit are variable fields. The tree has
a fixed depth: number of tokens, then the leading tokens. What follows in a leaf
is cut into segments, and a template of the leaf is a line with one segment, or
two, generalised to a variable field, as long as four fifths of the tokens stay.
A leaf keeps as many templates as it has: each is a key of its own, counted by
the documents that share it. Lines with a template that recurs in several
documents are dropped.

Lines are parsed once. From then on a line is a few numbers, digests of its
masked form, its leaf and its segments; no text is a key of a shuffle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.common import stored

LEADING = 3
SEGMENTS = 8
MIN_DOCS = 5
FIELD = "<*>"
# Sets of segments that a template may leave open; the first leaves none.
OPEN = [s for k in range(3) for s in combinations(range(SEGMENTS), k)]


def mask(lines: Column) -> Column:
    """Lines with single blanks, and every token that has a digit as a variable field."""
    blank = lambda x: F.when(F.rlike(x, F.lit(r"[\t\n\x0B\f\r]|  ")), F.regexp_replace(x, r"[ \t\n\x0B\f\r]++", " ")).otherwise(x)
    # Starts at the beginning of a token alone and never goes back.
    field = lambda x: F.when(F.rlike(x, F.lit("[0-9]")), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(x)
    return F.transform(F.transform(F.transform(lines, blank), F.trim), field)


def _bounds(rest: Column, segment: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment of ``rest`` tokens."""
    start, end = (F.floor(rest * k / F.lit(SEGMENTS)).cast("int") for k in (segment, segment + 1))
    return start, end - start


def parsed(texts: DataFrame) -> DataFrame:
    """(doc, k, line, leaf, n, segments): every line that is not blank, in numbers. ``texts`` has ``doc`` and ``text``."""
    lines = texts.select("doc", F.posexplode(mask(F.split("text", "\n"))).alias("k", "masked")).where("masked <> ''")
    tokens = lines.select("doc", "k", F.xxhash64("masked").alias("line"), F.split("masked", " ").alias("t"))
    sized = tokens.withColumn("n", F.size("t"))
    rest = F.greatest(F.col("n") - LEADING, F.lit(0))
    segments = []
    for s in range(SEGMENTS):
        start, size = _bounds(rest, s)
        segments.append(F.hash(F.slice("t", start + LEADING + 1, size)))
    leaf = F.xxhash64("n", F.slice("t", 1, LEADING))
    return sized.select("doc", "k", "line", leaf.alias("leaf"), "n", F.array(*segments).alias("segments"))


def template_keys(leaf: Column, n: Column, segments: Column) -> Column:
    """Digests of the templates that a line fits."""
    rest = F.greatest(n - LEADING, F.lit(0))
    sizes = [_bounds(rest, s)[1] for s in range(SEGMENTS)]
    keys = []
    for number, open_ in enumerate(OPEN):
        fixed = [segments[s] for s in range(SEGMENTS) if s not in open_]
        key = F.xxhash64(F.lit(number), leaf, *fixed)
        out = sum((sizes[s] for s in open_), F.lit(0))
        allowed = 5 * (n - out) >= 4 * n
        for s in open_:
            allowed = allowed & (sizes[s] > 0)
        keys.append(F.when(allowed, key))
    return F.array_compact(F.array(*keys))


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line): lines with a template that recurs, out of parsed lines.

    A line counts once for a document. Leaves that cannot hold a recurring
    template are left out before segments move.
    """
    counted = lines.select("leaf", "line", "doc").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"))
    busy = counted.groupBy("leaf").agg(F.sum("docs").alias("_n")).where(F.col("_n") >= min_docs).select("leaf")
    candidates = stored(counted.join(busy.hint("merge"), "leaf"), "lines")
    shapes = lines.select("line", "n", "segments").join(candidates.select("line").hint("merge"), "line", "left_semi")
    shaped = shapes.groupBy("line").agg(F.first("n").alias("n"), F.first("segments").alias("segments"))
    keyed = candidates.join(shaped.hint("merge"), "line").select("line", "docs", F.explode(template_keys(F.col("leaf"), F.col("n"), F.col("segments"))).alias("key"))
    keys = stored(keyed, "keys")
    often = keys.groupBy("key").agg(F.sum("docs").alias("_n")).where(F.col("_n") >= min_docs).select("key")
    return keys.join(often.hint("merge"), "key", "left_semi").select("line").distinct()


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_dropped: one row per input row.

    Lines end at a line feed; blank lines are kept and count for nothing. A
    template recurs if it occurs in ``min_docs`` documents, each counted once for
    every different line. A null text stays null, without lines; texts have any
    length. A document is its id and text: repeated rows count once and share
    their verdict, rows with an equal id and another text are documents of their
    own. An empty table gives an empty table; other columns are not looked at.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = texts.withColumn("doc", F.xxhash64("doc_id", "text"))
    lines = stored(parsed(named.where(F.col("text").isNotNull())), "parsed")
    gone = stored(recurring(lines, min_docs), "templates")
    found = (
        lines.select("doc", "k", "line")
        .join(gone.hint("merge"), "line", "left_semi")
        .groupBy(F.col("doc").alias("_doc"))
        .agg(F.collect_set("k").alias("gone"))
    )
    out = named.join(found.hint("merge"), F.col("doc") == F.col("_doc"), "left").select("doc_id", "text", F.array_sort("gone").alias("gone"))
    parts = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(parts, F.col("gone")), "\n"))
    return out.select(
        "doc_id",
        kept.alias("text"),
        F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(parts: Column, gone: Column) -> Column:
    """Elements whose place is not in a sorted array of places: the stretches between those places, one after another."""
    before = F.concat(F.array(F.lit(-1)), gone)
    after = F.concat(gone, F.array(F.size(parts)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(parts, a + 2, b - a - 1)))
