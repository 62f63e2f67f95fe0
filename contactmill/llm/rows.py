"""Run a per-text function over a table in Arrow slices, without pulling a whole batch into Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_ROWS = 128
SLICE_CHARS = 600_000


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply ``f = make()`` to every row of ``df``; ``f(*row)`` gives one output row (a tuple).

    ``make`` runs once per task, so models are built on the executor. Rows are
    handled in slices of ``SLICE_ROWS``; only one slice is in Python objects.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                columns = [c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns]
                rows = [f(*row) for row in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t.type) for c, t in zip(zip(*rows), target)], schema=target
                )

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``f = make()`` is true of the text.

    ``f`` takes a list of texts, which ends at ``SLICE_ROWS`` texts or with the text that brings it to ``SLICE_CHARS``.
    """
    at_text = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            at, texts, chars = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(at_text)[i].as_py())
                chars += len(texts[-1] or "")
                if chars >= SLICE_CHARS or len(texts) == SLICE_ROWS or i + 1 == batch.num_rows:
                    yield batch.slice(at, len(texts)).filter(pa.array(f(texts), pa.bool_()))
                    at, texts, chars = i + 1, [], 0

    return df.mapInArrow(run, df.schema)


def stream_rows(df: DataFrame, transform: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``transform`` to the rows of every partition, in their order, as one stream of tuples."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in transform(_tuples(batches)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(held) >= SLICE_ROWS or size > 1 << 20:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return df.mapInArrow(run, schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns])


class RecentCache:
    """A dictionary of bounded size: two generations, the older one dropped when the newer is full."""

    def __init__(self, size: int, compute: Callable):
        self.size, self.compute, self.new, self.old = size, compute, {}, {}

    def fill(self, key):
        """The value of a key that ``new`` lacks."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.new[key] = value
        return value
