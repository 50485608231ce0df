"""Inverted-file index: vectors assigned to the cells of a spherical k-means, a few cells probed per query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import check_vectors, normalize
from ..plans.storage import cut
from . import kmeans
from .blocks import QUERY_BLOCK, best_pairs, empty_result, fold_dot, lists, matrix, query_blocks, scan
from .exact import SLACK, _kernel, against, unit_queries

#: Folders of a table of lists at most.
MOST_FOLDERS = 1_024


@dataclass(frozen=True)
class IVFConfig:
    dims: int
    nlist: int
    max_iterations: int = 100
    tolerance: float = 1e-4
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.dims, self.nlist, self.max_iterations) < 1 or self.tolerance <= 0:
            raise ValueError("dims, nlist, max_iterations and tolerance must be positive")


def route(q: np.ndarray, centroids: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``nprobe`` best cells of each query and their dot products, best first, then lower cell."""
    s = np.stack([fold_dot(q, np.broadcast_to(c, q.shape)) for c in centroids], axis=1)
    order = np.argsort(-s, axis=1, kind="stable")[:, :nprobe]
    return order, np.take_along_axis(s, order, axis=1)


def listed(rows: DataFrame, nlist: int) -> DataFrame:
    """The lists as a written table in folders by cell, so that a search reads the probed ones only.

    Beyond ``MOST_FOLDERS`` lists a folder holds several. A long list is several files: the exchange
    before the write is rebalanced by Spark, which splits large partitions.
    """
    at = F.pmod(F.col("centroid_id"), F.lit(min(nlist, MOST_FOLDERS))).cast("int")
    return cut(rows.withColumn("folder", at).hint("rebalance", "folder"), "lists", ["folder"])


def probed_lists(lists: DataFrame, nlist: int, cells: list[int]) -> DataFrame:
    """The rows of the probed cells."""
    out = lists.where(F.col("centroid_id").isin(cells))
    if "folder" in lists.columns:
        out = out.where(F.col("folder").isin(sorted({c % min(nlist, MOST_FOLDERS) for c in cells}))).drop("folder")
    return out


def probing(queries: DataFrame, index, nprobe: int, prepare, block: int = QUERY_BLOCK) -> Iterator[tuple[dict, DataFrame]]:
    """Per query block: for each probed cell the queries that probe it, as ``prepare(q, coarse dots)`` packs them, and the probed lists."""
    centroids, nlist = index.centroids, index.cfg.nlist
    nprobe = min(nprobe, nlist)
    for t in query_blocks(queries, "query_id", block):
        if not t.num_rows:
            continue
        qid, q = t.column("query_id").to_numpy(), matrix(t.column("vector"))
        cells, dots = route(q, centroids, nprobe)
        by_cell = {}
        for c in np.unique(cells).tolist():
            r, j = np.nonzero(cells == c)
            by_cell[c] = (qid[r], *prepare(q[r], dots[r, j]))
        yield by_cell, probed_lists(index.lists, nlist, sorted(by_cell))


def _list_kernel(k: int):
    def best(by_cell, batch: pa.RecordBatch):
        cell = batch.column(2).to_numpy(zero_copy_only=False)
        ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
        out = [[], [], []]
        for c in np.unique(cell).tolist():
            if c not in by_cell:
                continue
            qid, q = by_cell[c]
            rows = np.nonzero(cell == c)[0]
            r, j = best_pairs(q @ x[rows].T, k, SLACK)
            for o, v in zip(out, (qid[r], ids[rows[j]], fold_dot(q[r], x[rows[j]]))):
                o.append(v)
        return [np.concatenate(o) if o else np.zeros(0) for o in out]

    return best


@dataclass
class IVFIndex:
    """``lists``: ``(id, vector, centroid_id)``; immutable, so a failed build leaves nothing behind."""

    cfg: IVFConfig
    centroids: np.ndarray
    lists: DataFrame
    size: int
    iterations: int = 0

    @classmethod
    def build(cls, vectors: DataFrame, cfg: IVFConfig) -> "IVFIndex":
        n = check_vectors(vectors, "vector", cfg.dims)
        if n == 0:
            raise ValueError("no vectors to index")
        if cfg.nlist > n:
            raise ValueError("nlist exceeds the number of vectors")
        unit = cut(vectors.select(F.col("id").cast("long"), normalize(F.col("vector")).alias("vector")), "ivf-unit")
        c, rounds = kmeans.fit_kmeans(unit, kmeans.KMeansConfig(cfg.nlist, cfg.max_iterations, cfg.tolerance, cfg.seed))
        return cls(cfg, c, listed(kmeans.assign(unit, c), cfg.nlist), n, rounds)

    def centroid_table(self) -> DataFrame:
        spark = self.lists.sparkSession
        t = pa.table({"centroid_id": pa.array(range(len(self.centroids)), pa.int32()), "centroid": lists(self.centroids)})
        return spark.createDataFrame(t)

    def routing(self, queries: DataFrame, nprobe: int = 8) -> DataFrame:
        """``(query_id, rank, centroid_id, score)`` of the probed cells."""
        if nprobe < 1:
            raise ValueError("nprobe must be positive")
        q = unit_queries(queries, self.cfg.dims)
        base = self.centroid_table().select(F.col("centroid_id").cast("long").alias("id"), F.col("centroid").alias("vector"))
        n = min(nprobe, self.cfg.nlist)
        found = scan(against(q, base), _kernel(n), n)
        return (empty_result(queries) if found is None else found).withColumnRenamed("id", "centroid_id")

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """``(query_id, rank, id, score)`` from the probed lists; unprobed lists are pruned from the read."""
        if nprobe < 1:
            raise ValueError("nprobe must be positive")
        if k == 0:
            return empty_result(queries)
        found = scan(probing(unit_queries(queries, self.cfg.dims), self, nprobe, lambda q, _: (q,)), _list_kernel(k), k)
        return empty_result(queries) if found is None else found

    def cluster_stats(self) -> DataFrame:
        return kmeans.cluster_stats(self.lists, self.cfg.nlist)

    def save(self, path: str) -> None:
        """Lists in folders by cell (so a probe reads its cells only), centroids and settings beside them."""
        self.lists.hint("rebalance", "folder").write.partitionBy("folder").parquet(f"{path}/lists")
        self.centroid_table().coalesce(1).write.parquet(f"{path}/centroids")
        spark = self.lists.sparkSession
        spark.createDataFrame([(*asdict(self.cfg).values(), self.size, self.iterations)], "dims int, nlist int, max_iterations int, tolerance double, seed int, size long, iterations int").coalesce(1).write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IVFIndex":
        s = spark.read.parquet(f"{path}/settings").first()
        c = spark.read.parquet(f"{path}/centroids").orderBy("centroid_id").toArrow()
        held = spark.read.parquet(f"{path}/lists").select("id", "vector", "centroid_id", "folder")
        return cls(IVFConfig(s["dims"], s["nlist"], s["max_iterations"], s["tolerance"], s["seed"]), matrix(c.column("centroid")), held, s["size"], s["iterations"])
