"""Python functions of single rows, run over Arrow batches a slice at a time: what a worker holds doesn't grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Input rows, and output rows of one batch.
ROWS_IN, ROWS_OUT = 64, 2048


def flat_map(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that `make` gives for the columns of each row of `df`."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            rows: list[tuple] = []
            for k in range(0, p.num_rows, ROWS_IN):
                for x in zip(*[c.to_pylist() for c in p.slice(k, ROWS_IN).columns]):
                    for r in make(*x):
                        rows.append(r)
                        if len(rows) == ROWS_OUT:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)

    return df.mapInArrow(work, schema)
