"""A row callback as a SQL table function.

``register_callback(spark, "visit", fn, returns)`` makes ``SELECT * FROM visit(TABLE(papers) PARTITION BY year ORDER BY
paper_id)`` call ``fn(row, state)`` for every row of a partition in its order. ``fn`` yields result rows; ``state`` is a
dict of the partition, empty at its start, of ``max_state`` entries at most. Rows come and go in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_STATE = 1000

Callback = Callable[[Row, dict], Iterable[tuple]]


def register_callback(
    spark: SparkSession, name: str, fn: Callback, returns: T.StructType | str, last: Callable[[dict], Iterable[tuple]] | None = None, max_state: int = MAX_STATE
) -> None:
    """``last(state)`` yields rows once a partition has ended; a partition without rows calls nothing."""

    class RowCallback:
        def __init__(self) -> None:
            self.state: dict = {}

        def eval(self, row: Row):
            yield from fn(row, self.state) or ()
            if len(self.state) > max_state:
                raise ValueError(f"the state of a partition grew beyond {max_state} entries")

        def terminate(self):
            if last is not None and self.state:
                yield from last(self.state)

    spark.udtf.register(name, F.udtf(RowCallback, returnType=returns, useArrow=True))
