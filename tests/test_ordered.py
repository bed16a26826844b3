"""Block-wise ordered columns against a plain loop, with blocks far smaller than the keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tamperlens.functions.groups import capped_lists, first_per_key, join_per_key
from tamperlens.functions.ordered import annotate, carry_forward, previous_value, running_sum


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, at = [], 0
    for _ in range(400):
        at += rng.choice([1, 1, 2, 9])
        key = rng.choice(["hot", "hot", "hot", "cold", "rare"])
        out.append((key, at, rng.choice([None, rng.randint(0, 9)])))
    return out


@pytest.mark.parametrize("width", [1, 3, 16, 65536])
def test_annotate_matches_loop(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, at bigint, v int")
    got = annotate(
        df, ["k"], "at", sums={"total": F.coalesce("v", F.lit(0)).cast("bigint")},
        carries={"upto": (F.col("v"), True), "before": (F.col("v"), False)}, width=width,
    ).collect()
    state, want = {}, set()
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        total, latest = state.get(key, (0, None))
        now = value if value is not None else latest
        want.add((key, at, value, total + (value or 0), now, latest))
        state[key] = (total + (value or 0), now)
    assert {tuple(r) for r in got} == want


def test_wrappers(spark, rows):
    df = spark.createDataFrame(rows, "k string, at bigint, v int")
    lagged = previous_value(df, ["k"], "at", F.col("v"), "p", width=4)
    from pyspark.sql import Window

    truth = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("at")))
    assert sorted(map(str, lagged.collect())) == sorted(map(str, truth.collect()))
    assert running_sum(df, ["k"], "at", F.lit(1), "n", width=4).agg(F.max("n")).first()[0] == max(
        sum(r[0] == k for r in rows) for k in ("hot", "cold", "rare")
    )
    assert carry_forward(df, ["k"], "at", F.col("v"), "c", width=4).count() == len(rows)


def test_capped_lists_and_first(spark):
    df = spark.createDataFrame([("a", f"x{i % 30:02d}", i) for i in range(300)] + [("b", "y", 1)], "k string, item string, n int")
    capped = {r["k"]: r for r in capped_lists(df, ["k"], F.col("item"), 5).collect()}
    assert capped["a"]["items"] == [f"x{i:02d}" for i in range(5)]
    assert (capped["a"]["total"], capped["a"]["distinct_total"]) == (300, 30)
    assert capped["b"]["items"] == ["y"]
    assert {r["k"]: r["n"] for r in first_per_key(df, ["k"], ["n"]).collect()} == {"a": 0, "b": 1}


def test_group_limit_is_pushed_below_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("item"))
    plan = capped_lists(df, ["k"], F.col("item"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_join_per_key(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    right = spark.createDataFrame([("hot", 5)], "k string, v int")
    assert join_per_key(left, right, ["k"], F.col("at"), salts=4).agg(F.sum("v")).first()[0] == 5000
