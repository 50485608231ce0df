"""Exact top-k by cosine: the expression form and the block form, which agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_vectors, dot, normalize
from ..plans.storage import cut
from .blocks import best_pairs, empty_result, fold_dot, matrix, query_blocks, scan

SLACK = 1e-5


def exact_top_k_expression(base: DataFrame, queries: DataFrame, k: int, broadcast_rows: int = 10_000) -> DataFrame:
    """Top-k with columns only; ``base`` is ``(id, vector)``, ``queries`` ``(query_id, vector)``, both unit.

    The queries must be few (checked): they are the broadcast side of a nested loop.
    """
    if queries.limit(broadcast_rows + 1).count() > broadcast_rows:
        raise ValueError("too many queries for a nested loop; use ExactIndex.search")
    q = queries.select("query_id", F.col("vector").alias("q"))
    scored = base.crossJoin(F.broadcast(q)).select("query_id", "id", dot(F.col("q"), F.col("vector")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _kernel(k: int):
    def best(payload, batch: pa.RecordBatch):
        qid, q = payload
        ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
        r, c = best_pairs(q @ x.T, k, SLACK)
        s = fold_dot(q[r], x[c])
        return qid[r], ids[c], s

    return best


def against(queries: DataFrame, base: DataFrame) -> Iterator[tuple[tuple, DataFrame]]:
    """The query blocks, each held against all of ``base``."""
    for t in query_blocks(queries, "query_id"):
        if t.num_rows:
            yield (t.column("query_id").to_numpy(), matrix(t.column("vector"))), base


def unit_queries(queries: DataFrame, dims: int) -> DataFrame:
    """Checked and normalized ``(query_id, vector)``; a query without direction is an error."""
    check_vectors(queries, "vector", dims)
    return queries.select(F.col("query_id").cast("long"), normalize(F.col("vector")).alias("vector"))


class ExactIndex:
    """A table of unit vectors; grows by append."""

    def __init__(self, dims: int, vectors: DataFrame | None = None) -> None:
        if dims < 1:
            raise ValueError("dims must be positive")
        self.dims, self.vectors, self._size = dims, None, 0
        if vectors is not None:
            self.add(vectors)

    def add(self, vectors: DataFrame) -> "ExactIndex":
        """Appends ``(id, vector)`` rows after checking them; a flawed row rejects the call."""
        n = check_vectors(vectors, "vector", self.dims)
        new = cut(vectors.select(F.col("id").cast("long"), normalize(F.col("vector")).alias("vector")), "exact")
        self.vectors = new if self.vectors is None else self.vectors.unionByName(new)
        self._size += n
        return self

    def size(self) -> int:
        return self._size

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, rank, id, score)``: score descending, then id."""
        if k == 0 or self.vectors is None:
            return empty_result(queries)
        found = scan(against(unit_queries(queries, self.dims), self.vectors), _kernel(k), k)
        return empty_result(queries) if found is None else found

