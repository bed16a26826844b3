"""Small text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(tests: list[tuple[Column, object]]) -> Column:
    """Value of the first true test, else NULL; later tests are not evaluated."""
    result = None
    for test, value in tests:
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(test, value) if result is None else result.when(test, value)
    return result


def any_contains(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
