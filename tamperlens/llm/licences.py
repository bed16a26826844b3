"""Licence scan by digests of canonical texts, in DataFrame operations only.

Case, punctuation, copyright lines, spellings and white space are normalised;
the digest of a whole text, or of a whole line that speaks of a licence, is
looked up among digests of known licences and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.licence_texts import LICENCES, NOTICES

# Patterns are the same in both engines that run them. A line is a copyright line by what follows the word: a sign, a
# year, a place for a name, or "by". A line of wrapped prose that begins with the word is none.
COPYRIGHT = (
    r"(^|\n)[^\p{L}\p{N}\n]{0,20}(portions |modifications )?"
    r"(copyright[ \t:]*(\(c\)|©|&copy;|[<\[{]|[0-9]{4}|by )|\(c\)[ \t]*(copyright[ \t]*)?[<\[{0-9]|©)[^\n]*"
)
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("recognise", "recognize"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"),
    ("https://", "http://"), ("all rights reserved", " "),
)
NOT_WORDS = r"[^\p{L}\p{N}]+"
# Every known notice has this in its canonical form; a test holds that.
ANCHOR = "licen"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words and numbers with single blanks."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(out, NOT_WORDS, " "))


def known(spark, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, licence) of a fixed list of texts; forms that are one after normalising are one row."""
    named = F.inline(F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(t).alias("text")) for name, t in texts]))
    digest = F.sha2(canonical(F.col("text")).cast("binary"), 256)
    return spark.range(1).select(named).groupBy(digest.alias("digest")).agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence (of the whole text, or null), notices (licences named by whole lines), n_notices.

    One row per input row. Texts may be wrapped at any width, behind comment
    marks or not; the holder and year of copyright lines are of no matter, any other
    word is. The known tables are fixed lists of a few rows, so
    they are broadcast. Lines without the word are not canonicalised. A null or
    empty text matches nothing. Notices of a document are gathered in the
    row, in order of name. An empty table gives an empty table; other columns are not
    looked at.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(canonical(F.col(text_col)).cast("binary"), 256).alias("digest"),
        F.transform(
            F.filter(F.split(F.col(text_col), "\n"), lambda x: F.contains(F.lower(x), F.lit(ANCHOR))),
            lambda x: F.sha2(canonical(x).cast("binary"), 256),
        ).alias("lines"),
    )
    named = F.create_map(*[x for name, t in NOTICES.items() for x in (F.sha2(canonical(F.lit(t)).cast("binary"), 256), F.lit(name))])
    joined = rows.join(F.broadcast(known(spark, LICENCES)), "digest", "left")
    found = F.filter(F.transform("lines", lambda d: F.element_at(named, d)), lambda x: x.isNotNull())
    return joined.withColumn("found", F.coalesce(found, F.array().cast("array<string>"))).select(
        "doc_id",
        "licence",
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
        F.size("found").cast("long").alias("n_notices"),
    )
