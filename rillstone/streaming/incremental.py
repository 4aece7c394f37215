"""Facts that arrive as a stream: each micro-batch extends a program's result.

For programs without negation and non-recursive aggregates, where more facts
never take a row away. A batch that Spark delivers again, after a failure, adds
nothing: relations are sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rillstone.program import Result


def follow(stream: DataFrame, result: Result, relation: str, checkpoint: str, after: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Starts a query that adds the stream's rows to an input relation and derives what follows.

    `after` is called with each batch's number and the rows that each relation gained.
    """

    def extend(batch: DataFrame, number: int) -> None:
        gained = result.extend({relation: batch})
        if after is not None:
            after(number, gained)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(extend).start()
