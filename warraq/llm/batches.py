"""Shared pieces: Arrow batches to Python lists and back, partial counts, stored models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``df`` through a function of whole columns.

    ``make`` runs once a task and returns a function from the columns of a
    batch, as lists, to the result's columns, as lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or make()
            out = each(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def partial_counts(df: DataFrame, fold: Callable[[dict, tuple], None], flush_at: int = 400_000) -> DataFrame:
    """(key, n) sums of what ``fold`` adds to a task's dictionary, batch by batch.

    A task sums in memory and hands its sums on whenever the dictionary holds
    ``flush_at`` keys, so memory is bounded while no key is dropped; the JVM
    adds the partial sums up.
    """
    arrow = pa.schema([("key", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            fold(sums, tuple(c.to_pylist() for c in batch.columns))
            if len(sums) >= flush_at:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], schema=arrow)
                sums.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], schema=arrow)

    return df.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
