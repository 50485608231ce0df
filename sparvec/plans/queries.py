"""The registered similarity-search queries over the test tables.

Each builds its own index over the whole ``embeddings`` table; its searches ask for every row whose
identifier is divisible by 50, against all rows.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import kmeans
from ..operators.blocks import matrix, query_blocks
from ..operators.exact import ExactIndex, exact_top_k_expression, unit_queries
from ..operators.hnsw import HNSWConfig, HNSWIndex, count_unreachable
from ..operators.ivf import IVFConfig, IVFIndex
from ..operators.ivfpq import IVFPQConfig, IVFPQIndex, residuals
from ..operators.pq import PQConfig, PQIndex
from ..operators.textsearch import DocumentSearch
from ..sources import recordlog
from ..sources.glovetext import read_embedding_text
from ..sources.randomvectors import random_vectors
from . import evaluate as E
from .storage import cut, shared_dir

DIMS, K, SEED = 64, 10, 42
NLIST, ROUNDS, NPROBE = 8, 5, 2
M, CODES, PQ_ROUNDS = 4, 16, 2
#: So small that training stops early only where nothing moves any more.
STILL = 1e-12
#: The mean of 1 - cos is half the mean squared move: between the two the rules stop in different rounds.
COSINE_STOP = 0.018
NEEDLE = "gasket"
LABEL = 3
BASE_ROWS = 400
SAMPLES = [("exact", [812.0, 790.5, 801.25]), ("ivf", [5400.0, 5512.5, 4999.0, 5301.0]), ("hnsw", [16366.0])]
TOY_EDGES = [(0, 1), (1, 2), (2, 0), (3, 0), (4, 5), (5, 4), (2, 6)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).select("id", V.normalize(F.col("vector")).alias("vector"))


def _shown(results: DataFrame) -> DataFrame:
    return results.select("query_id", F.col("rank").cast("int").alias("rank"), "id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def _doubles(c: str) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def exact_topk_batch(spark, d):
    return _shown(ExactIndex(DIMS, _base(spark, d)).search(_queries(spark, d), K))


def exact_topk_expression(spark, d):
    q = _queries(spark, d).select("query_id", V.normalize(F.col("vector")).alias("vector"))
    return _shown(exact_top_k_expression(_unit(spark, d), q, K))


def exact_topk_single(spark, d):
    one = _base(spark, d).where("id = 0").select(F.col("id").alias("query_id"), "vector")
    q = one.select("query_id", V.normalize(F.col("vector")).alias("q"))
    scored = _unit(spark, d).crossJoin(F.broadcast(q)).select("query_id", "id", V.dot(F.col("q"), F.col("vector")).alias("score"))
    top = scored.orderBy(F.col("score").desc(), "id").limit(K)
    return _shown(top.withColumn("rank", F.row_number().over(E.ordered_by_score())))


def exact_topk_filtered(spark, d):
    held = _table(spark, d, "embeddings").where(F.col("label") == LABEL).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _shown(ExactIndex(DIMS, held).search(_queries(spark, d), K))


def normalize_vectors(spark, d):
    return _unit(spark, d).select("id", _doubles("vector").alias("vector"))


def _neighbouring_pairs(spark, d):
    a = _unit(spark, d).select("id", F.col("vector").alias("a"))
    b = _unit(spark, d).select((F.col("id") - 1).alias("id"), F.col("vector").alias("b"))
    return a.join(b, "id")


def pairwise_dot(spark, d):
    return _neighbouring_pairs(spark, d).select("id", (F.round(V.dot(F.col("a"), F.col("b")), 6) + 0.0).alias("value"))


def pairwise_sq_l2(spark, d):
    return _neighbouring_pairs(spark, d).select("id", (F.round(V.squared_l2(F.col("a"), F.col("b")), 6) + 0.0).alias("value"))


def pairwise_cosine_distance(spark, d):
    p = _neighbouring_pairs(spark, d).select("id", V.cosine_distance(F.col("a"), F.col("b")).alias("x"))
    return p.select("id", (F.round("x", 6) + 0.0).alias("distance"), (F.round(1 - F.col("x"), 6) + 0.0).alias("score"))


def vector_validation_report(spark, d):
    return V.validation_report(_table(spark, d, "glove_embeddings"), "vector", 50)


def subvector_slice(spark, d):
    w = DIMS // M
    parts = [F.struct(F.lit(j).alias("m"), F.transform(V.subvector(F.col("vector"), j, w), lambda x: x.cast("double")).alias("part")) for j in range(M)]
    return _unit(spark, d).select("id", F.explode(F.array(*parts)).alias("s")).select("id", "s.m", "s.part")


def _trained(spark, d, rule="l2", tolerance=STILL):
    unit = cut(_unit(spark, d), "unit")
    c, _ = kmeans.fit_kmeans(unit, kmeans.KMeansConfig(NLIST, ROUNDS, tolerance, SEED, rule=rule))
    return unit, c


def _centroid_rows(spark, c):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "cid int, centroid array<double>")


def kmeans_centroids(spark, d):
    return _centroid_rows(spark, _trained(spark, d)[1])


def kmeans_cosine_stop_rule(spark, d):
    return _centroid_rows(spark, _trained(spark, d, "cosine", COSINE_STOP)[1])


def nearest_centroid_assignment(spark, d):
    unit, c = _trained(spark, d)
    return kmeans.assign(unit, c).select("id", F.col("centroid_id").alias("cid"))


def residual_vectors(spark, d):
    unit, c = _trained(spark, d)
    return residuals(kmeans.assign(unit, c), c).select("id", _doubles("vector").alias("residual"))


def heldout_split_sample(spark, d):
    _, pool = V.held_out_split(_base(spark, d), "id", BASE_ROWS)
    return V.sample_by_hash(pool, "id", 20, SEED).select("id")


def _ivf(spark, d):
    return IVFIndex.build(_base(spark, d), IVFConfig(DIMS, NLIST, ROUNDS, STILL, SEED))


def ivf_routing(spark, d):
    r = _ivf(spark, d).routing(_queries(spark, d), NPROBE)
    return r.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("centroid_id").cast("int").alias("cid"), (F.round("score", 6) + 0.0).alias("score"))


def ivf_topk_full_probe(spark, d):
    return _shown(_ivf(spark, d).search(_queries(spark, d), K, NLIST))


def ivf_topk_nprobe2(spark, d):
    return _shown(_ivf(spark, d).search(_queries(spark, d), K, NPROBE))


def ivf_cluster_stats(spark, d):
    s = _ivf(spark, d).cluster_stats()
    return s.select("min_size", "max_size", F.round("mean_size", 6).alias("mean_size"), F.round("stddev_size", 6).alias("stddev_size"), "empty_clusters")


def _pq(spark, d):
    return PQIndex.build(_base(spark, d), PQConfig(DIMS, M, CODES, PQ_ROUNDS, STILL, SEED))


def pq_codes(spark, d):
    codes = F.transform(F.sequence(F.lit(1), F.lit(M)), lambda i: F.conv(F.hex(F.substring("codes", i, F.lit(1))), 16, 10).cast("int"))
    return _pq(spark, d).codes.select("id", codes.alias("codes"))


def pq_decode(spark, d):
    index = _pq(spark, d)
    return index.quantizer.decode(index.codes).select("id", _doubles("vector").alias("vector"))


def _tables(spark, d, kind):
    quantizer = _pq(spark, d).quantizer
    rows = []
    for t in query_blocks(unit_queries(_queries(spark, d), DIMS), "query_id", 512):
        made = getattr(quantizer, kind)(matrix(t.column("vector")))
        q, m, k = (x.ravel() for x in np.meshgrid(t.column("query_id").to_numpy(), np.arange(M), np.arange(CODES), indexing="ij"))
        rows.append(pa.table({"query_id": pa.array(q), "m": pa.array(m.astype(np.int32)), "k": pa.array(k.astype(np.int32)), "value": pa.array(made.ravel())}))
    return spark.createDataFrame(pa.concat_tables(rows)).withColumn("value", F.round("value", 6) + 0.0)


def pq_distance_table(spark, d):
    return _tables(spark, d, "distance_table")


def pq_dot_table(spark, d):
    return _tables(spark, d, "dot_table")


def pq_adc_topk(spark, d):
    return _shown(_pq(spark, d).search(_queries(spark, d), K))


def _ivfpq(spark, d):
    return IVFPQIndex.build(_base(spark, d), IVFPQConfig(DIMS, NLIST, M, CODES, ROUNDS, STILL, PQ_ROUNDS, SEED))


def ivfpq_topk(spark, d):
    return _shown(_ivfpq(spark, d).search(_queries(spark, d), K, NPROBE))


def ivfpq_cluster_stats(spark, d):
    s = _ivfpq(spark, d).cluster_stats()
    return s.select("min_size", "max_size", F.round("mean_size", 6).alias("mean_size"), F.round("stddev_size", 6).alias("stddev_size"), "empty_clusters")


def memory_report(spark, d):
    pq, both = _pq(spark, d), _ivfpq(spark, d)
    n = _base(spark, d).count()
    rows = [("exact", 4 * DIMS, n * 4 * DIMS), ("pq", pq.bytes_per_vector(), pq.total_bytes()), ("ivfpq", both.bytes_per_vector(), both.total_bytes())]
    return spark.createDataFrame([(a, int(b), int(c), E.compression_ratio(DIMS, b)) for a, b, c in rows], "method string, bytes_per_vector long, total_bytes long, compression double")


def recall_at_k_ivf(spark, d):
    q = _queries(spark, d)
    exact = ExactIndex(DIMS, _base(spark, d)).search(q, K)
    return E.recall_at_k(exact, _ivf(spark, d).search(q, K, NPROBE), q).select("query_id", F.round("recall", 6).alias("recall"))


def qps_summary(spark, d):
    rows = spark.createDataFrame([(m, x) for m, xs in SAMPLES for x in xs], "method string, qps double")
    return rows.groupBy("method").agg(E.middle_median("qps").alias("median_mid"), E.upper_median("qps").alias("median_upper"), F.min("qps").alias("qps_min"), F.max("qps").alias("qps_max"))


def score_checksum(spark, d):
    return E.score_checksum(ExactIndex(DIMS, _base(spark, d)).search(_queries(spark, d), K)).select(F.round("checksum", 4).alias("checksum"))


def _hnsw(spark, d, **kw):
    return HNSWIndex.build(_base(spark, d), HNSWConfig(DIMS, 16, 100, SEED, **kw))


def hnsw_topk_full_beam(spark, d):
    index = _hnsw(spark, d, num_shards=1)
    return _shown(index.search(_queries(spark, d), K, max(K, index.size)))


def hnsw_topk_ef50(spark, d):
    r = _hnsw(spark, d, shard_rows=250).search(_queries(spark, d), K, 50)
    return r.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"), "distance_computations")


def hnsw_stats(spark, d):
    return _hnsw(spark, d, num_shards=1).stats()


def hnsw_unreachable(spark, d):
    edges = spark.createDataFrame(TOY_EDGES, "src long, dst long")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    n = count_unreachable(nodes, edges, spark.createDataFrame([(0,)], "id long"))
    return spark.createDataFrame([(n,)], "unreachable long")


def hnsw_unreachable_rows(spark, d):
    """Rows that layer 0 does not reach from the entry: by frontier joins over the edge table, and counted inside the task."""
    index = _hnsw(spark, d, num_shards=1)
    edges = index.edges().where("level = 0").select("src", "dst")
    nodes, entry = index.graph.select(F.col("row").alias("id")), index.graph.where("entry").select(F.col("row").alias("id"))
    n = count_unreachable(nodes, edges, entry)
    return index.stats().select("size", F.lit(n).cast("long").alias("by_joins"), F.col("unreachable").alias("in_task"))


def hnsw_topk_grown(spark, d):
    """A graph of the even identifiers into which the odd ones are inserted, searched at full beam."""
    base = _base(spark, d)
    index = HNSWIndex.build(base.where("id % 2 = 0"), HNSWConfig(DIMS, 16, 100, SEED, num_shards=1)).add(base.where("id % 2 = 1"))
    return _shown(index.search(_queries(spark, d), K, max(K, index.size)))


def index_recall(spark, d):
    """One setting of each index that reaches a recall of 0.9, against the exact scan."""
    configs = [
        ("ivf", IVFConfig(DIMS, NLIST, ROUNDS, STILL, SEED), [NLIST - 1]),
        ("pq", PQConfig(DIMS, DIMS, 64, PQ_ROUNDS, STILL, SEED)),
        ("ivfpq", IVFPQConfig(DIMS, NLIST, DIMS, 64, ROUNDS, STILL, PQ_ROUNDS, SEED), [NLIST]),
        ("hnsw", HNSWConfig(DIMS, 16, 100, SEED), [50]),
    ]
    return E.evaluate(_base(spark, d), _queries(spark, d), DIMS, K, configs).select("method", "knobs", "recall")


def glove_text_scan(spark, d):
    path = f"{shared_dir(spark)}/sparvec/text-{uuid.uuid4().hex}"
    rows = _base(spark, d).orderBy("id").select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("id").cast("string")), F.concat_ws("  ", F.transform("vector", lambda x: x.cast("string")))).alias("value"))
    rows.coalesce(1).write.text(path)
    return read_embedding_text(spark, path, DIMS, 2**31 - 1).select("id", "term", _doubles("vector").alias("vector"))


def substring_search(spark, d):
    return DocumentSearch(_table(spark, d, "documents").select("doc_id", "text")).search(NEEDLE).select("doc_id")


def _log_path(spark) -> str:
    at = shared_dir(spark)
    folder = at[len("file://") :] if at.startswith("file://") else at
    if not folder.startswith("/"):
        raise RuntimeError("a record log is a file: spark.checkpoint.dir must be a folder mounted on all machines")
    os.makedirs(f"{folder}/sparvec", exist_ok=True)
    return f"{folder}/sparvec/{uuid.uuid4().hex}.log"


def _filled_log(spark, d) -> str:
    """The evaluation items as records, in order; the log is written by the driver, record by record."""
    path = _log_path(spark)
    with recordlog.RecordLog(path) as log:
        for r in _table(spark, d, "eval_items").select("item_id", "text").orderBy("item_id").toLocalIterator():
            log.append(r["text"].encode(), 0.0)
    return path


def _read_log(spark, path) -> DataFrame:
    recordlog.register(spark)
    # the checksum covers the record's header (id, time, length; all little-endian, the time here 0) and its data
    def little(c: Column) -> Column:
        big = F.lpad(F.hex(c), 8, "0")
        return F.unhex(F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)]))

    held = F.concat(little(F.col("rec_id")), F.lit(b"\0\0\0\0"), little(F.length("data").cast("long")), F.col("data"))
    whole = F.unhex(F.sha2(held, 256)) == F.col("checksum")
    return spark.read.format("recordlog").load(path).select("rec_id", F.decode("data", "UTF-8").alias("text"), whole.alias("sound"))


def log_roundtrip(spark, d):
    return _read_log(spark, _filled_log(spark, d))


def log_torn_tail(spark, d):
    path = _filled_log(spark, d)
    with open(path, "ab") as f:  # a whole record whose checksum is wrong, then too few bytes for another
        f.write(b"\x07" * recordlog.CHECKSUM + struct.pack("<IfI", 10_000, 0.0, 5) + b"wrong" + b"\x07" * 30)
    with recordlog.RecordLog(path) as log:
        log.append(b"after the crash", 0.0)
    return _read_log(spark, path)


def log_stream_replay(spark, d):
    path = _filled_log(spark, d)
    recordlog.register(spark)
    out = f"{shared_dir(spark)}/sparvec/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.format("recordlog").load(path).select("rec_id", F.decode("data", "UTF-8").alias("text"))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(once=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def random_gaussian(spark, d):
    return random_vectors(spark, 10_000, 128).select("id", F.round(V.norm(F.col("vector")), 6).alias("norm"))


def evaluate_grid(spark, d):
    configs = [
        ("exact",),
        ("ivf", IVFConfig(DIMS, NLIST, ROUNDS, STILL, SEED), [1, 4, 8]),
        ("pq", PQConfig(DIMS, 8, CODES, PQ_ROUNDS, STILL, SEED)),
        ("ivfpq", IVFPQConfig(DIMS, NLIST, 8, CODES, ROUNDS, STILL, PQ_ROUNDS, SEED), [1, 8]),
        ("hnsw", HNSWConfig(DIMS, 8, 64, SEED), [10, 40]),
    ]
    return E.evaluate(_base(spark, d), _queries(spark, d), DIMS, K, configs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            exact_topk_batch, exact_topk_expression, exact_topk_single, exact_topk_filtered, normalize_vectors, pairwise_dot, pairwise_sq_l2,
            pairwise_cosine_distance, vector_validation_report, subvector_slice, kmeans_centroids, kmeans_cosine_stop_rule,
            nearest_centroid_assignment, residual_vectors, heldout_split_sample, ivf_routing, ivf_topk_full_probe, ivf_topk_nprobe2,
            ivf_cluster_stats, pq_codes, pq_decode, pq_distance_table, pq_dot_table, pq_adc_topk, ivfpq_topk, ivfpq_cluster_stats,
            memory_report, recall_at_k_ivf, qps_summary, score_checksum, hnsw_topk_full_beam, hnsw_topk_ef50, hnsw_stats,
            hnsw_unreachable, hnsw_unreachable_rows, hnsw_topk_grown, index_recall, glove_text_scan, substring_search, log_roundtrip, log_torn_tail, log_stream_replay, random_gaussian, evaluate_grid,
        )
    }


def oracle_sql() -> dict[str, str]:
    from .oracle import statements

    return statements()
