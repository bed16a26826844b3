"""A corpus pipeline: quality, language, exact copies, near copies, packing.

Each stage takes the documents that the one before kept and writes what it
keeps; all but the last return the columns of ``documents``. ``sf_dir`` is read
for labels alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.llm import crf, factor, fuse, minhash, packing
from tamperlens.llm.common import shared_dir, stored
from tamperlens.llm.queries import TOKENIZER_FILE

# A document goes if its language cannot be told, or no language has most of it.
LEAST_LANGUAGE = 0.4


def _free(docs: DataFrame, name: str) -> str:
    """A name for a helper column that no column of the documents has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 go.

    Every row is scored by itself: null and empty texts by their structure, repeated
    rows and ids alike, texts of any length whole. Without labels of both kinds
    every score is 0.5 and all go. An empty table gives an empty table; other
    columns, whatever their names, are carried through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = factor.fit(factor.training_rows(docs, labels, ~factor.held_out(F.col("doc_id"))))
    return docs.where(factor.score_column(machine, docs) >= factor.KEEP)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; given languages are only learned from.

    Null and empty texts, and texts without a letter, have none; nor has any text
    where no language is given at all. Rows are told apart by nothing but their
    text, so repeated ones share their fate. An empty table gives an empty table;
    other columns, whatever their names, are carried through.
    """
    model = crf.fit(crf.training_rows(docs, ~factor.held_out(F.col("doc_id"))))
    # Under numbers for names, no column clashes with those that are added.
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    told = crf.identify_with(model, numbered, dict(numbered.dtypes), f"c{docs.columns.index('text')}")
    kept = told.where((F.col("lang_pred") != crf.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return kept.select(*(F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of those with the largest id.

    A null text equals an empty one. Texts that share an id are told apart; of rows
    that share both, one stays. A null id loses to any other. An empty table gives an
    empty table; other columns, whatever their names, are carried through.
    """
    new = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 1
    found = fuse.exact_duplicates(docs, new)
    key = _free(docs, "row_key")
    named = lambda digest: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digest)
    gone = found.where("not kept").select(named(F.col("text_sha256")).alias(key)).distinct()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # One exchange deals out documents for the join and for what is left of repeated rows.
    return docs.withColumn(key, named(F.sha2(text, 256))).join(gone.hint("merge"), key, "left_anti").dropDuplicates([key]).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one row stays, the one with the smallest id (a null id before all).

    Rows are numbered, so texts that share an id are told apart and each group of
    copies, repeated rows among them, leaves one row. Texts without words have no
    copies. An empty table gives an empty table; other columns, whatever their
    names, are carried through.
    """
    row = _free(docs, "row_number")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    near = stored(minhash.near_duplicates(rows, row).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "near")
    several = near.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    members = near.join(several, "component").join(ids, "row")
    stay = members.groupBy("component").agg(F.min(F.struct("id", "row"))["row"].alias("first"))
    gone = members.join(stay, "component").where("row <> first").select(F.col("row").alias(row))
    return rows.join(gone.hint("merge"), row, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; rows, null texts and long ones as ``packing.pack`` says."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER_FILE))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

# Learned and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}-{name}")
    return docs
