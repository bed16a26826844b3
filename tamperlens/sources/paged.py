"""Random access to files of any size: pages are fetched when they are touched, and only a few are held.

Parsers of structure (directories, listings, opcodes) read a file through
``Pages`` as if it were in memory; what they skip is never read.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.sources.chunks import _open
from tamperlens.sources.frames import frames

PAGE, HELD = 1 << 20, 8


class Pages(io.RawIOBase):
    """A file of known size over anything that seeks and reads. Slices give bytes; it is a raw stream as well."""

    def __init__(self, handle, size: int, page: int = PAGE, held: int = HELD):
        self.handle, self.size, self.page, self.held, self.at = handle, size, page, held, 0
        self.fetched = 0
        self.pages: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def __bool__(self) -> bool:
        return True

    def _page(self, number: int) -> bytes:
        if number in self.pages:
            self.pages.move_to_end(number)
            return self.pages[number]
        self.handle.seek(number * self.page)
        data = self.handle.read(min(self.page, self.size - number * self.page))
        self.fetched += 1
        self.pages[number] = data
        if len(self.pages) > self.held:
            self.pages.popitem(last=False)
        return data

    def __getitem__(self, place: slice) -> bytes:
        start, stop, _ = place.indices(self.size)
        parts = []
        while start < stop:
            number, inside = divmod(start, self.page)
            part = self._page(number)[inside : inside + stop - start]
            if not part:  # the file has become shorter
                break
            parts.append(part)
            start += len(part)
        return b"".join(parts)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, buffer) -> int:
        # At most the rest of one page: a large read goes on with the next call.
        number, inside = divmod(self.at, self.page)
        data = self._page(number)[inside : inside + len(buffer)] if self.at < self.size else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def opened(path: str) -> Pages:
    handle = _open(path)
    return Pages(handle, handle.size())


def stream(source: Pages | bytes) -> io.BufferedIOBase:
    """A buffered stream of a paged file or of bytes."""
    return io.BytesIO(source) if isinstance(source, bytes) else io.BufferedReader(source, 1 << 16)


def per_file(files: DataFrame, entries: Callable[[str, Pages | bytes], Iterator[tuple]], schema, heavy: int | None = None) -> DataFrame:
    """Rows of ``entries(path, data)`` for every file: its ``content``, or pages of the file where there is no such column.

    A file that cannot be read, or breaks what reads it, ends its own rows.
    """
    whole = "content" in files.columns

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for k, path in enumerate(batch["path"]):
                try:
                    yield from entries(path, batch["content"][k] if whole else opened(path))
                except Exception:  # hostile files raise far more than the parsers' own errors
                    continue

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(rows(batches), schema.names, heavy=heavy)

    named = files.select("path", "content") if whole else files.select("path").repartition("path")
    return named.mapInPandas(job, schema)


def _ends(window: int, tail: int):
    def entries(path: str, data: Pages) -> Iterator[tuple]:
        yield path, len(data), data[:window], data[max(0, len(data) - tail) :]

    return entries


def ends(files: DataFrame, window: int, tail: int) -> DataFrame:
    """(path, length, content, tail): the first ``window`` and the last ``tail`` bytes of every file."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("path", StringType()), StructField("length", LongType()), StructField("content", BinaryType()), StructField("tail", BinaryType())])
    return per_file(files.select(F.col("path")), _ends(window, tail), schema, heavy=2)
