"""Small functions over single rows, in Arrow batches.

A batch's rows are turned into Python values one at a time, and results leave in pieces of a bounded size, so that a worker holds one
batch, one row and one piece, however large its partition is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows, and characters in their strings, of one piece of results.
ROWS, CHARS = 4096, 1 << 21

KINDS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def by_row(rows: DataFrame, each: Callable[..., Iterable[tuple]], columns: Mapping[str, str]) -> DataFrame:
    """The tuples that `each(*values of a row)` gives for every row, as `columns` (name: Spark type)."""
    schema = pa.schema([(n, KINDS[k]) for n, k in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for at in range(b.num_rows):
                for row in each(*[c[at].as_py() for c in b.columns]):
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, str))
                    if len(held) >= ROWS or size >= CHARS:
                        yield piece()
                        held, size = [], 0
        if held:
            yield piece()
        held = []
        pa.default_memory_pool().release_unused()  # Spark keeps idle workers, and what they have freed with them
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in columns.items()))
