"""Recall, throughput and size of the indexes against the exact scan.

Each row of a report is one setting: what a benchmark program prints, as a table. Throughput is
measured on whole batches of queries written to the ``noop`` sink.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.exact import ExactIndex
from ..operators.hnsw import HNSWConfig, HNSWIndex
from ..operators.ivf import IVFConfig, IVFIndex
from ..operators.ivfpq import IVFPQConfig, IVFPQIndex
from ..operators.pq import PQConfig, PQIndex

REPORT = "method string, knobs string, recall double, bytes_per_vector double, build_s double, qps_median double, qps_min double, qps_max double, work double, compression double, speedup double"


def recall_at_k(exact: DataFrame, approx: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, recall)``: the share of the exact result found; a query without exact rows counts as 1."""
    hits = exact.join(approx.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("h"))
    size = exact.groupBy("query_id").agg(F.count("*").alias("n"))
    per = queries.select("query_id").join(size, "query_id", "left").join(hits, "query_id", "left")
    return per.select("query_id", F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def mean_recall(exact: DataFrame, approx: DataFrame, queries: DataFrame) -> float:
    return recall_at_k(exact, approx, queries).agg(F.avg("recall")).first()[0]


def ordered_by_score() -> Window:
    """One query's results in order; for the few rows a limit has left."""
    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())


def middle_median(values: Column | str) -> Column:
    """The mean of the two middle values."""
    return F.median(values)


def upper_median(values: str) -> Column:
    """The upper of the two middle values."""
    held = F.array_sort(F.collect_list(values))
    return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))


def qps_samples(search: Callable[[], DataFrame], queries: int, repetitions: int) -> list[float]:
    if queries < 1 or repetitions < 1:
        raise ValueError("queries and repetitions must be positive")
    out = []
    for _ in range(repetitions):
        t = time.perf_counter()
        search().write.format("noop").mode("overwrite").save()
        out.append(queries / (time.perf_counter() - t))
    return out


def score_checksum(results: DataFrame) -> DataFrame:
    """One row: the sum of the best scores."""
    return results.where("rank = 1").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("checksum"))


def compression_ratio(dims: int, bytes_per_vector: float) -> float:
    return 4 * dims / bytes_per_vector


def evaluate(base: DataFrame, queries: DataFrame, dims: int, k: int, configs: list[tuple], repetitions: int = 1) -> DataFrame:
    """A report row per setting; ``speedup`` is over the exact scan where that was measured before. ``configs``: ``("exact",)``, ``("ivf", IVFConfig, [nprobe])``, ``("pq", PQConfig)``,
    ``("ivfpq", IVFPQConfig, [nprobe])``, ``("hnsw", HNSWConfig, [ef])``; knobs an index cannot take are skipped.
    """
    spark, n = base.sparkSession, queries.count()
    exact_qps: float | None = None
    exact_index = ExactIndex(dims, base)
    truth = exact_index.search(queries, k).persist()
    rows = []

    def measure(method: str, knobs: str, search, bytes_per_vector: float, build_s: float, work=None) -> None:
        found = search().persist()
        r = mean_recall(truth, found, queries)
        w = found.agg(F.avg("distance_computations")).first()[0] if "distance_computations" in found.columns else work
        found.unpersist()
        s = sorted(qps_samples(search, n, repetitions))
        median = s[len(s) // 2]
        speedup = 1.0 if method == "exact" else None if exact_qps is None else median / exact_qps
        rows.append((method, knobs, r, float(bytes_per_vector), build_s, median, s[0], s[-1], None if w is None else float(w), compression_ratio(dims, bytes_per_vector), speedup))

    for method, *rest in configs:
        t = time.perf_counter()
        if method == "exact":
            measure("exact", "", lambda: exact_index.search(queries, k), 4 * dims, 0.0, exact_index.size())
            exact_qps = rows[-1][5]
        elif method == "ivf":
            ivf = IVFIndex.build(base, rest[0])
            took = time.perf_counter() - t
            for p in [p for p in rest[1] if p <= rest[0].nlist]:
                measure("ivf", f"nlist={rest[0].nlist} nprobe={p}", lambda p=p: ivf.search(queries, k, p), 4 * dims, took)
        elif method == "pq":
            if dims % rest[0].m:
                continue
            pq = PQIndex.build(base, rest[0])
            measure("pq", f"m={rest[0].m}", lambda: pq.search(queries, k), pq.bytes_per_vector(), time.perf_counter() - t)
        elif method == "ivfpq":
            both = IVFPQIndex.build(base, rest[0])
            took = time.perf_counter() - t
            for p in [p for p in rest[1] if p <= rest[0].nlist]:
                measure("ivfpq", f"m={rest[0].m} nlist={rest[0].nlist} nprobe={p}", lambda p=p: both.search(queries, k, p), both.bytes_per_vector(), took)
        elif method == "hnsw":
            graph = HNSWIndex.build(base, rest[0])
            took = time.perf_counter() - t
            size = graph.stats().first()
            for ef in [ef for ef in rest[1] if ef >= k]:
                measure("hnsw", f"m={rest[0].m} ef_construction={rest[0].ef_construction} ef={ef}", lambda ef=ef: graph.search(queries, k, ef), size["payload_bytes"] / max(1, size["size"]), took)
        else:
            raise ValueError(f"no such method: {method}")
    truth.unpersist()
    return spark.createDataFrame(rows, REPORT)


def positive(text: str) -> int:
    """A positive decimal integer and nothing else."""
    if not (text.isascii() and text.isdigit()) or int(text) < 1:
        raise argparse.ArgumentTypeError(f"{text!r} is not a positive integer")
    return int(text)


def main(argv: list[str] | None = None) -> int:
    """``python -m sparvec.plans.evaluate METHOD``: the benchmark programs on random vectors or a table."""
    p = argparse.ArgumentParser(prog="evaluate")
    p.add_argument("method", choices=["exact", "ivf", "pq", "ivfpq", "hnsw"])
    p.add_argument("--table", help="Parquet table with id and vector columns; else Gaussian vectors")
    p.add_argument("--text", help="embedding text file: a term and its numbers a line, numbered in order")
    p.add_argument("--count", type=positive, default=100_000)
    p.add_argument("--dims", type=positive, default=128)
    p.add_argument("--queries", type=positive, default=100)
    p.add_argument("--k", type=positive, default=10)
    p.add_argument("--nlist", type=positive, default=316)
    p.add_argument("--m", type=positive, nargs="*", default=None)
    p.add_argument("--ef-construction", type=positive, nargs="*", default=[100, 200, 400])
    p.add_argument("--repetitions", type=positive, default=3)
    a = p.parse_args(argv)
    from ..functions.vectors import held_out_split, sample_by_hash
    from ..session import local_session
    from ..sources.glovetext import read_embedding_text
    from ..sources.randomvectors import random_vectors

    try:
        spark = local_session()
        need = a.count + max(10 * a.queries, 5000)
        if a.text:
            table = read_embedding_text(spark, a.text, a.dims, need).select("id", "vector")
        elif a.table:
            table = spark.read.parquet(a.table).select("id", "vector")
        else:
            table = random_vectors(spark, need, a.dims)
        base, pool = held_out_split(table, "id", a.count)
        queries = sample_by_hash(pool, "id", a.queries).select(F.col("id").alias("query_id"), "vector").persist()
        if queries.count() < a.queries:
            raise ValueError("the table holds fewer rows than the benchmark needs")
        # The published grids of settings.
        sweep = {
            "exact": [("exact",)],
            "ivf": [("exact",), ("ivf", IVFConfig(a.dims, a.nlist), [1, 4, 8, 10, 12, 14, 16, 32])],
            "pq": [("exact",), *[("pq", PQConfig(a.dims, m)) for m in (a.m or [5, 10, 25]) if a.dims % m == 0]],
            "ivfpq": [("exact",), *[("ivfpq", IVFPQConfig(a.dims, a.nlist, m), [1, 8, 32]) for m in (a.m or [10, 25]) if a.dims % m == 0]],
            "hnsw": [("exact",), *[("hnsw", HNSWConfig(a.dims, m, e), [10, 20, 40, 80, 160, 320]) for m in (a.m or [8, 16, 32]) for e in a.ef_construction]],
        }
        evaluate(base, queries, a.dims, a.k, sweep[a.method], a.repetitions).show(200, truncate=False)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
