"""Top-k for a stream of queries against a fixed index: each micro-batch is one search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``search`` on each micro-batch of ``(query_id, vector)`` rows and hands its result to ``sink``.

    The sink sees the batch number, so it can write idempotently; with the checkpoint that makes results exactly-once.
    """

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                sink(search(held), number)
        finally:
            held.unpersist()

    return queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
