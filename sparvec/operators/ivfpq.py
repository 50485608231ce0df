"""Inverted lists of product-quantized residuals; the score is q.c + q.r from a lookup table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import check_vectors, normalize
from ..plans.storage import cut
from . import kmeans
from .blocks import empty_result, lists, matrix, scan
from .exact import unit_queries
from .ivf import listed, probing
from .pq import TABLE_BLOCK, PQConfig, ProductQuantizer, encode_block, packed_codes, table_sums, unpacked_codes


@dataclass(frozen=True)
class IVFPQConfig:
    """``max_iterations`` may be 0: the coarse centroids are then the initial ones."""

    dims: int
    nlist: int
    m: int
    k: int = 256
    max_iterations: int = 100
    tolerance: float = 1e-4
    pq_iterations: int = 50
    seed: int = 42

    def __post_init__(self) -> None:
        if self.nlist < 1:
            raise ValueError("nlist must be positive")
        self.pq  # checks the rest

    @property
    def pq(self) -> PQConfig:
        return PQConfig(self.dims, self.m, self.k, self.pq_iterations, self.tolerance, self.seed)


def residuals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, vector, centroid_id)`` with the vector replaced by vector - centroid in float32. Map-only."""
    sent = assigned.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = sent.value[b.column(2).to_numpy(zero_copy_only=False)]
                r = (matrix(b.column(1)).astype(np.float64) - c.astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), lists(r), b.column(2)], names=["id", "vector", "centroid_id"])

    return assigned.mapInArrow(run, "id long, vector array<float>, centroid_id int")


def _kernel(k: int):
    def best(by_cell, batch: pa.RecordBatch):
        cell = batch.column(1).to_numpy(zero_copy_only=False)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        out = [[], [], []]
        codes = None
        for c in np.unique(cell).tolist():
            if c not in by_cell:
                continue
            qid, table, coarse = by_cell[c]
            if codes is None:
                codes = unpacked_codes(batch.column(2), table.shape[1])
            rows = np.nonzero(cell == c)[0]
            s = coarse[:, None] + table_sums(table, codes[rows])
            if s.shape[1] > k:
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                r, j = np.nonzero(s >= kth[:, None])
            else:
                r, j = np.nonzero(np.isfinite(s))
            for o, v in zip(out, (qid[r], ids[rows[j]], s[r, j])):
                o.append(v)
        return [np.concatenate(o) if o else np.zeros(0) for o in out]

    return best


@dataclass
class IVFPQIndex:
    """``lists``: ``(id, centroid_id, codes)``. The raw vectors are not kept."""

    cfg: IVFPQConfig
    centroids: np.ndarray
    quantizer: ProductQuantizer
    lists: DataFrame
    size: int

    @classmethod
    def build(cls, vectors: DataFrame, cfg: IVFPQConfig) -> "IVFPQIndex":
        n = check_vectors(vectors, "vector", cfg.dims)
        if n == 0:
            raise ValueError("no vectors to index")
        if cfg.nlist > n or cfg.k > n:
            raise ValueError("nlist or k exceeds the number of vectors")
        unit = cut(vectors.select(F.col("id").cast("long"), normalize(F.col("vector")).alias("vector")), "ivfpq-unit")
        c, _ = kmeans.fit_kmeans(unit, kmeans.KMeansConfig(cfg.nlist, cfg.max_iterations, cfg.tolerance, cfg.seed, rule="cosine"))
        rest = cut(residuals(kmeans.assign(unit, c), c), "ivfpq-residuals")
        quantizer = ProductQuantizer.train(rest, cfg.pq)
        sent = vectors.sparkSession.sparkContext.broadcast(quantizer.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), packed_codes(encode_block(matrix(b.column(1)), sent.value))], names=["id", "centroid_id", "codes"])

        return cls(cfg, c, quantizer, listed(rest.mapInArrow(run, "id long, centroid_id int, codes binary"), cfg.nlist), n)

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        if k < 1 or nprobe < 1:
            raise ValueError("k and nprobe must be positive")
        # a query brings a table of m x k numbers for each cell it probes
        blocks = probing(unit_queries(queries, self.cfg.dims), self, nprobe, lambda q, coarse: (self.quantizer.dot_table(q), coarse), TABLE_BLOCK)
        found = scan(blocks, _kernel(k), k)
        return empty_result(queries) if found is None else found

    def cluster_stats(self) -> DataFrame:
        return kmeans.cluster_stats(self.lists, self.cfg.nlist)

    def bytes_per_vector(self) -> int:
        return self.cfg.m

    def total_bytes(self) -> int:
        return self.lists.agg(F.coalesce(F.sum(F.length("codes")), F.lit(0))).first()[0]
