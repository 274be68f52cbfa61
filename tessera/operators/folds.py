"""Folds of ordered rows, a group at a time, that hold a fold's state and one Arrow batch instead of a group's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

Step = Callable[..., tuple | None]
End = Callable[[], list[tuple]]


def nothing() -> list[tuple]:
    return []


def fold_rows(rows: DataFrame, by: str, order: list[str], make: Callable[[Any], tuple[Step, End]], schema: str) -> DataFrame:
    """Rows of each group `by` handed in order, as values in the order of the columns, to the step that `make` gives the group.

    A step returns an output row or None, the end further rows. Spark sorts, on disk where it must. Groups are spread over
    spark.sql.shuffle.partitions tasks and not put together by their bytes, as it is their steps that cost.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, by).sortWithinPartitions(by, *order)
    at, kinds = rows.columns.index(by), to_arrow_schema(DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        group: Any = run
        step, end = None, nothing
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step is None or row[at] != group:
                    out += end()
                    group = row[at]
                    step, end = make(group)
                got = step(*row)
                if got is not None:
                    out.append(got)
            if out:
                yield batch_of(out)
        out = end()
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(run, schema)


def attempts(rows: DataFrame, *keys) -> DataFrame:
    """rows with `attempts`: how many have the same keys. A fold that counts them can forget a decision after its last attempt."""
    return rows.withColumn("attempts", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


class Decided:
    """What was decided for operations that will be tried again, until their last attempt."""

    def __init__(self) -> None:
        self.outcomes: dict = {}
        self.tried: dict = {}

    def known(self, op, attempts: int) -> str | None:
        """The outcome so far of an operation of so many attempts, this one counted."""
        if attempts < 2:
            return None
        n = self.tried.get(op, 0) + 1
        if n < attempts:
            self.tried[op] = n
            return self.outcomes.get(op)
        self.tried.pop(op, None)
        return self.outcomes.pop(op, None)

    def decide(self, op, outcome: str) -> str:
        if op in self.tried:
            self.outcomes[op] = outcome
        return outcome
