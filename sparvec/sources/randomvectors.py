"""Gaussian vectors whose every row depends on its number and the seed alone: a generator per block of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that one generator makes.
BLOCK = 1_024


def random_vectors(spark: SparkSession, n: int, dims: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``(id, vector)`` for ids 0..n-1; the same rows under any partitioning."""
    if n < 1 or dims < 1:
        raise ValueError("n and dims must be positive")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = np.empty((len(ids), dims), np.float32)
            for block in np.unique(ids // BLOCK):
                here = ids // BLOCK == block
                made = np.random.Generator(np.random.Philox(key=[seed, int(block)])).standard_normal((BLOCK, dims), np.float32)
                x[here] = made[ids[here] - block * BLOCK]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * dims, dims, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "vector"])

    source = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    return source.mapInArrow(make, "id long, vector array<float>")
