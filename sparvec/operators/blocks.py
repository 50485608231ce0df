"""Block kernels: numpy over Arrow batches, with the small side broadcast in bounded blocks.

A scan is map-only: the table of vectors is never shuffled, whatever its skew. Each task keeps the
k best rows of a batch per query, Spark's window keeps the k best of those. The matrix product only
proposes candidates; their scores are folded in double, left to right, as the column expressions do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut

QUERY_BLOCK = 4_096


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as rows of a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
    if len(column) == 0:
        return np.zeros((0, 0), np.float32)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d or 1, dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(x, np.float32).ravel()))


def fold_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products in double, component by component."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return out


def best_pairs(rough: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest entries and of all within ``slack`` of the k-th."""
    if rough.shape[1] > k:
        kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        return np.nonzero(rough >= (kth - slack)[:, None])
    return np.nonzero(np.isfinite(rough))


def query_blocks(queries: DataFrame, id_col: str, block: int = QUERY_BLOCK) -> Iterator[pa.Table]:
    """The queries in blocks of about ``block`` rows; only one is on the driver at a time."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    for j in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == j)
        yield part.orderBy(id_col).toArrow()


def scan(blocks: Iterator[tuple[object, DataFrame]], kernel: Callable, k: int, ascending: bool = False) -> DataFrame | None:
    """``(query_id, rank, id, score)``: ``kernel(payload, batch)`` gives (query ids, ids, scores) of a batch's best rows.

    ``blocks``: each block of queries as a payload, which is broadcast, and the table it is held
    against. One block is planned as it is; of several each is run and its results written before
    the next is read, so the driver holds one block however many there are. None without a block.
    """
    order = F.col("score").asc() if ascending else F.col("score").desc()
    best = Window.partitionBy("query_id").orderBy(order, F.col("id").asc())

    def one(payload, base: DataFrame) -> tuple[DataFrame, object]:
        sent = base.sparkSession.sparkContext.broadcast(payload)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    q, i, s = kernel(sent.value, b)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

        found = base.mapInArrow(run, "query_id long, id long, score double")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), sent

    held, done = next(blocks, None), None
    while held is not None:
        found, sent = one(*held)
        held = next(blocks, None)
        if held is None and done is None:
            return found
        written = cut(found, "block")
        sent.destroy()
        done = written if done is None else done.unionByName(written)
    return done


def empty_result(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
