"""Grouped helpers whose memory per key stays bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_lists(
    df: DataFrame,
    keys: list[str],
    item: Column,
    k: int,
    items: str = "items",
    total: str = "total",
    distinct: str = "distinct_total",
) -> DataFrame:
    """Per key: the first ``k`` distinct items in order, and the true totals.

    Duplicates are counted away before the shuffle; the rank filter is pushed
    below it (a group limit per task), so no task ever holds a whole key.
    """
    counted = (
        df.select(*keys, item.alias("_item"))
        .where(F.col("_item").isNotNull())
        .groupBy(*keys, "_item")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = counted.groupBy(*keys).agg(
        F.sum("_n").alias(total), F.count(F.lit(1)).alias(distinct)
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_item"))
    lists = (
        counted.withColumn("_rank", rank)
        .where(F.col("_rank") <= k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_item")).alias(items))
    )
    return totals.join(lists, keys)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key; filtered per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def join_per_key(df: DataFrame, per_key: DataFrame, keys: list[str], salt: Column, salts: int = 32) -> DataFrame:
    """Join one row per key onto a table in which one key may be very frequent.

    The frequent side is spread over ``salts`` copies of the per-key row. A side
    that proves small at run time is broadcast by adaptive execution instead.
    """
    spread = df.withColumn("_salt", F.pmod(salt.cast("bigint"), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: expressions above a generator cannot take theirs apart."""
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(made)))


def small_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table made of literals, so that no Python worker has to run for it."""
    fields = spark.createDataFrame([], schema).schema.fields
    cells = [
        F.struct(*[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*cells)))
