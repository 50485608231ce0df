"""k-means as a driver loop of map-only assignments and partial sums.

Each round broadcasts the k centroids (k x d floats), assigns every row in numpy and sums per task;
Spark adds the partial sums. Initial centroids are the first k rows in hash order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sample_by_hash
from .blocks import matrix


@dataclass(frozen=True)
class KMeansConfig:
    """``rule``: ``l2`` (mean squared move) or ``cosine`` (mean of 1 - cos of old and new)."""

    k: int
    max_iterations: int = 100
    tolerance: float = 1e-4
    seed: int = 42
    spherical: bool = True
    rule: str = "l2"

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be positive")
        if self.max_iterations < 0 or self.tolerance <= 0:
            raise ValueError("max_iterations must not be negative and tolerance must be positive")
        if self.rule not in ("l2", "cosine"):
            raise ValueError(f"no such stop rule: {self.rule}")


def nearest(x: np.ndarray, c: np.ndarray, spherical: bool) -> np.ndarray:
    """The nearest centroid of each row; of equally near ones the lowest."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    s = x @ c.T
    if not spherical:
        s = 2 * s - (c * c).sum(axis=1)
    return s.argmax(axis=1)


def _round(vectors: DataFrame, c: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) per centroid."""
    k, d = c.shape
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d)), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                at = nearest(x, sent.value, spherical)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=k)
        here = np.nonzero(count)[0]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(here) + 1) * d, d, dtype=np.int32)), pa.array(total[here].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(count[here]), rows], names=["c", "n", "s"])

    parts = vectors.select("vector").mapInArrow(partial, "c int, n long, s array<double>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(d)]).alias("s")).collect()  # k rows
    sums, counts = np.zeros((k, d)), np.zeros(k, np.int64)
    for r in rows:
        sums[r["c"]], counts[r["c"]] = r["s"], r["n"]
    return sums, counts


def moved(old: np.ndarray, new: np.ndarray, rule: str) -> float:
    """How far the centroids moved, by the stop rule."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    if rule == "l2":
        return float(((a - b) ** 2).sum(axis=1).mean())
    cos = (a * b).sum(axis=1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-300)
    return float(np.maximum(0.0, 1 - cos).mean())


def fit_kmeans(vectors: DataFrame, cfg: KMeansConfig) -> tuple[np.ndarray, int]:
    """Centroids (float32) of ``(id, vector)`` rows, and the rounds run. An empty cluster keeps its centroid."""
    first = sample_by_hash(vectors.select("id", "vector"), "id", cfg.k, cfg.seed, vectors.count()).toArrow()
    if first.num_rows < cfg.k:
        raise ValueError("k exceeds the number of vectors")
    c = matrix(first.column("vector")).copy()
    for done in range(1, cfg.max_iterations + 1):
        sums, counts = _round(vectors, c, cfg.spherical)
        mean = sums / np.maximum(counts, 1)[:, None]
        if cfg.spherical:
            n = np.sqrt((mean * mean).sum(axis=1))
            keep = (counts == 0) | (n == 0)
            mean = mean / np.where(n == 0, 1, n)[:, None]
        else:
            keep = counts == 0
        new = np.where(keep[:, None], c, mean.astype(np.float32)).astype(np.float32)
        step = moved(c, new, cfg.rule)
        c = new
        if step < cfg.tolerance:
            return c, done
    return c, cfg.max_iterations


def assign(vectors: DataFrame, c: np.ndarray, spherical: bool = True) -> DataFrame:
    """``vectors`` (id, vector) with ``centroid_id``. Map-only."""
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = nearest(matrix(b.column(1)), sent.value, spherical).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], names=["id", "vector", "centroid_id"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, vector array<float>, centroid_id int")


def cluster_stats(assigned: DataFrame, k: int) -> DataFrame:
    """One row over all ``k`` clusters, empty ones among them; the deviation is the population's."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("centroid_id").agg(F.count("*").alias("n"))
    every = spark.range(k).select(F.col("id").cast("int").alias("centroid_id")).join(counts, "centroid_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("stddev_size"), F.count_if(F.col("n") == 0).alias("empty_clusters")
    )
