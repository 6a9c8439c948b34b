"""Ordered replays: the rows of a key, one after the other, with a state that is carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ``step(state, row)`` gives the state after a row and the rows that it makes; the state of a new key is null.
Step = Callable[[Any, dict], tuple[Any, list[dict]]]


def replay(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: StructType) -> DataFrame:
    """``step`` over the rows of each key in the order of ``order`` (null first).

    Rows are dealt by key and sorted; each task walks through its rows and keeps the state
    of the key it is at, so a key can have any number of rows: what a task holds is one
    batch and one state.
    """
    form = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        state = None
        for batch in batches:
            made: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, None
                state, out = step(state, row)
                made.extend(out)
            yield pa.RecordBatch.from_pylist(made, schema=form)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)
