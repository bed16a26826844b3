"""Order-dependent columns that survive a hot key.

A window partitioned by the key alone sends every row of that key to one task.
Here rows are first cut into blocks of the (integer) order column; the windows
run inside (key, block), and one summary row per block carries the state
across. Only the summaries, up to ``width`` times fewer, meet in a per-key window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65536
_BLOCK = "_block"


def annotate(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    carries: dict[str, tuple[Column, bool]] | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add running sums and carried values in one pass.

    ``sums``: name -> value, summed over the rows of the key up to this one.
    ``carries``: name -> (value, include_current): the latest non-null value up
    to this row, or strictly before it. ``order`` is unique within a key.
    """
    sums, carries = sums or {}, carries or {}
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(_BLOCK, F.floor(F.col(order) / F.lit(width))).withColumns(
        {f"_v_{name}": value for name, (value, _) in carries.items()}
    )
    columns = {f"_s_{name}": F.sum(value).over(upto) for name, value in sums.items()}
    for name, (_, current) in carries.items():
        frame = upto if current else inside.rowsBetween(Window.unboundedPreceding, -1)
        columns[f"_l_{name}"] = F.last(f"_v_{name}", ignorenulls=True).over(frame)
    local = local.withColumns(columns)

    summaries = [F.max_by(f"_s_{name}", order).alias(f"_t_{name}") for name in sums] + [
        F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col(order))).alias(f"_t_{name}")
        for name in carries
    ]
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = local.groupBy(*keys, _BLOCK).agg(*summaries)
    blocks = blocks.select(
        *keys,
        _BLOCK,
        *[F.sum(f"_t_{name}").over(before).alias(f"_b_{name}") for name in sums],
        *[F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_b_{name}") for name in carries],
    )
    joined = local.join(blocks, [*keys, _BLOCK], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_s_{name}") + F.coalesce(F.col(f"_b_{name}"), F.lit(0))).alias(name) for name in sums],
        *[F.coalesce(f"_l_{name}", f"_b_{name}").alias(name) for name in carries],
    )


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    return annotate(df, keys, order, sums={out: value}, width=width)


def carry_forward(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, include_current: bool = True, width: int = WIDTH
) -> DataFrame:
    """Latest non-null ``value`` of the key up to (or strictly before) this row."""
    return annotate(df, keys, order, carries={out: (value, include_current)}, width=width)


def boxed(value: Column) -> Column:
    """A value that is carried even when it is null."""
    return F.struct(value.alias("v"))


def previous_value(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """Value of the preceding row of the key, as ``lag`` gives it."""
    carried = carry_forward(df, keys, order, boxed(value), out, include_current=False, width=width)
    return carried.withColumn(out, F.col(out)["v"])
