"""Rows from Python jobs, handed over in frames of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

ROWS, BYTES = 10_000, 32 * 1024 * 1024


def frames(rows: Iterator[tuple], columns: list[str], heavy: int | None = None) -> Iterator[pd.DataFrame]:
    """Frames over the rows of many files; ``heavy`` is the column that holds bytes.

    A frame ends at 10 000 rows or, with heavy columns, at about 32 MB.
    """
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        if heavy is not None and row[heavy] is not None:
            size += len(row[heavy])
        if len(held) >= ROWS or size >= BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)
