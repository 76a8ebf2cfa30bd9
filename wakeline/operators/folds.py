"""Ordered folds: rows of a key pass through a task in order with a small state, and no group is held in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame


def fold_rows(df: DataFrame, keys: list[str], order: list[str | Column], need: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], bool]) -> DataFrame:
    """The rows of df for which step(state, row) is true, seen key by key in order; start() makes a key's first state.

    step may change the state; a row is a tuple of the columns that step needs, in their order, and no other column leaves Arrow.  Spark deals the rows
    out by key and sorts them; a task holds one batch and one state.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state = None, None
        for batch in batches:
            own = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in need), strict=True)
            keep = []
            for now, row in zip(own, rows, strict=True):
                if state is None or now != key:
                    key, state = now, start()
                keep.append(step(state, row))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)


def unfold_rows(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple]], finish: Callable[[Any], list[tuple]]) -> DataFrame:
    """What step(state, row) makes of each row, and finish(state) of each key's end: rows of a schema, key by key in order.  Rows are tuples in df's columns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(parsed)
        key, state = None, None

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        for batch in batches:
            at = [batch.schema.get_field_index(k) for k in keys]
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = tuple(row[k] for k in at)
                if state is None or now != key:
                    if state is not None:
                        out += finish(state)
                    key, state = now, start()
                out += step(state, row)
            if out:
                yield batch_of(out)
        if state is not None and (out := finish(state)):
            yield batch_of(out)

    parsed = df.sparkSession.createDataFrame([], schema).schema
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, parsed)
