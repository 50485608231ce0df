import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvec.operators.exact import ExactIndex, exact_top_k_expression, unit_queries
from sparvec.operators.hnsw import HNSWConfig, HNSWIndex, LayeredGraph, count_unreachable
from sparvec.operators.ivf import IVFConfig, IVFIndex
from sparvec.operators.ivfpq import IVFPQConfig, IVFPQIndex
from sparvec.operators.pq import PQConfig, PQIndex, ProductQuantizer
from sparvec.plans import evaluate as E

V = "id long, vector array<float>"
Q = "query_id long, vector array<float>"
RING = [(3, 0), (2, 1), (0, 3), (-1, 2), (-3, 0), (-2, -1), (0, -3), (1, -2)]
RING_QUERIES = [(5, 1), (-2, 4), (-4, -2), (1, -5)]
S = 2**-0.5
UNIT4 = [(S, 0, 0, S), (0.8, 0, 0, 0.6), (-S, 0, 0, -S), (-0.8, 0, 0, -0.6)]
MIRRORED = [(1, 0, 0, 1, 2, 0), (1.1, 0, 0, 1.1, 2.1, 0), (-1, 0, 0, -1, -2, 0), (-1.1, 0, 0, -1.1, -2.1, 0)]


def table(spark, rows, schema=V):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], schema)


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 5)))
    return out


def gaussian(n, d, seed):
    return np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)


def test_exact_values_and_order(spark):
    index = ExactIndex(2, table(spark, [(2, 0), (0, 2), (-2, 0)]))
    assert result(index.search(table(spark, [(4, 0)], Q), 2)) == {0: [(0, 1.0), (1, 0.0)]}
    assert index.size() == 3
    assert index.search(table(spark, [(4, 0)], Q), 0).count() == 0
    assert ExactIndex(2).search(table(spark, [(4, 0)], Q), 3).count() == 0
    assert len(result(index.search(table(spark, [(4, 0)], Q), 10))[0]) == 3
    for bad in ([(0, 0)], [(1, 2, 3)]):
        with pytest.raises(ValueError):
            index.add(table(spark, bad))
    assert index.size() == 3
    with pytest.raises(ValueError):
        ExactIndex(0)
    with pytest.raises(ValueError):
        index.search(table(spark, [(0, 0)], Q), 1)


def test_ties_go_to_the_lower_id(spark):
    rows = [(1, 1), (2, 0), (1, 0), (3, 0), (5, 0)]
    assert result(ExactIndex(2, table(spark, rows)).search(table(spark, [(1, 0)], Q), 3)) == {0: [(1, 1.0), (2, 1.0), (3, 1.0)]}


def test_append_and_partitioning_do_not_change_results(spark):
    x = gaussian(300, 8, 3)
    q = table(spark, gaussian(5, 8, 4), Q)
    whole = result(ExactIndex(8, table(spark, x)).search(q, 7))
    grown = ExactIndex(8, table(spark, x).where("id < 100")).add(table(spark, x).where("id >= 100").repartition(5))
    assert result(grown.search(q, 7)) == whole
    unit = unit_queries(table(spark, x).withColumnRenamed("id", "query_id"), 8).withColumnRenamed("query_id", "id")
    assert result(exact_top_k_expression(unit, unit_queries(q, 8), 7)) == whole
    with pytest.raises(ValueError):
        exact_top_k_expression(unit, unit_queries(q, 8), 7, broadcast_rows=2)


def test_ivf_full_probe_is_exact_and_probes_nest(spark, tmp_path):
    base, q = table(spark, RING), table(spark, RING_QUERIES, Q)
    exact = ExactIndex(2, base).search(q, 3)
    index = IVFIndex.build(base, IVFConfig(2, 3))
    assert result(index.search(q, 3, 3)) == result(exact)
    assert result(index.search(q, 3, 99)) == result(exact)
    recalls = [E.mean_recall(exact, index.search(q, 3, p), q) for p in (1, 2, 3)]
    assert recalls == sorted(recalls) and recalls[-1] == 1
    index.save(str(tmp_path / "ivf"))
    again = IVFIndex.load(spark, str(tmp_path / "ivf"))
    assert again.cfg == index.cfg and result(again.search(q, 3, 2)) == result(index.search(q, 3, 2))


def test_only_probed_lists_are_read(spark):
    x = gaussian(600, 8, 3)
    index = IVFIndex.build(table(spark, x), IVFConfig(8, 6, 5))
    one = table(spark, x[:1], Q)
    held = index.lists.where(F.col("centroid_id") == index.routing(one, 1).first()["centroid_id"])
    found = index.search(one, 600, 1)
    assert {r["id"] for r in found.collect()} == {r["id"] for r in held.select("id").collect()} and held.count() < 600
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and len(index.lists.select("folder").distinct().collect()) == 6
    both = IVFPQIndex.build(table(spark, x), IVFPQConfig(8, 6, 2, 4, max_iterations=5))
    assert "PartitionFilters: [isnotnull(folder" in both.search(one, 5, 1)._jdf.queryExecution().executedPlan().toString()


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    base, q = table(spark, gaussian(300, 8, 3)), table(spark, gaussian(50, 8, 4), Q)
    searches = [ExactIndex(8, base).search, lambda q, k: IVFIndex.build(base, IVFConfig(8, 4, 3)).search(q, k, 2), PQIndex.build(base, PQConfig(8, 2, 8, 3)).search]
    whole = [result(f(q, 5)) for f in searches]
    import sparvec.operators.blocks as B

    real = B.query_blocks
    for module in ("exact", "ivf", "pq"):
        monkeypatch.setattr(f"sparvec.operators.{module}.query_blocks", lambda df, c, block=0: real(df, c, 12))
    assert [result(f(q, 5)) for f in searches] == whole
    assert result(searches[0](q.where("false"), 5)) == {}


def test_ivf_stats_and_rejections(spark):
    base = table(spark, [(1, 0), (0, 1), (-1, 0), (0, -1)])
    s = IVFIndex.build(base, IVFConfig(2, 2)).cluster_stats().first()
    assert s["mean_size"] == 2.0 and s["min_size"] + s["max_size"] == 4
    with pytest.raises(ValueError):
        IVFIndex.build(base, IVFConfig(2, 5))
    with pytest.raises(ValueError):
        IVFIndex.build(table(spark, [(1, 0), (0, 0)]), IVFConfig(2, 1))
    with pytest.raises(ValueError):
        IVFIndex.build(base, IVFConfig(2, 2)).search(base.withColumnRenamed("id", "query_id"), 1, 0)
    for bad in (dict(dims=0, nlist=1), dict(dims=2, nlist=0), dict(dims=2, nlist=1, max_iterations=0), dict(dims=2, nlist=1, tolerance=0)):
        with pytest.raises(ValueError):
            IVFConfig(**bad)


def test_pq_codec(spark):
    base = table(spark, UNIT4)
    quantizer = ProductQuantizer.train(base, PQConfig(4, 2, 2))
    codes = quantizer.encode(base)
    assert all(len(r["codes"]) == 2 for r in codes.collect())
    back = {r["id"]: r["vector"] for r in quantizer.decode(codes).collect()}
    assert all(len(v) == 4 for v in back.values())
    q = np.array([UNIT4[0]], np.float32)
    assert quantizer.distance_table(q).shape == (1, 2, 2) and (quantizer.distance_table(q) >= 0).all() and quantizer.dot_table(q).max() > 0
    again = quantizer.encode(spark.createDataFrame([(i, v) for i, v in back.items()], V))
    assert {r["id"]: bytes(r["codes"]) for r in again.collect()} == {r["id"]: bytes(r["codes"]) for r in codes.collect()}


def test_pq_index(spark):
    index = PQIndex.build(table(spark, MIRRORED), PQConfig(6, 3, 2))
    assert index.bytes_per_vector() == 3 and index.total_bytes() == 12
    found = result(index.search(table(spark, [MIRRORED[0]], Q), 2))[0]
    assert len(found) == 2 and found[0][0] in (0, 1) and found[0][1] <= found[1][1]
    assert index.search(table(spark, [MIRRORED[0]], Q), 0).count() == 0
    with pytest.raises(ValueError):
        PQConfig(5, 2)
    with pytest.raises(ValueError):
        PQConfig(4, 2, 257)
    with pytest.raises(ValueError):
        PQIndex.build(table(spark, UNIT4), PQConfig(4, 2, 5))


def test_ivfpq(spark):
    index = IVFPQIndex.build(table(spark, MIRRORED), IVFPQConfig(6, 2, 3, 2))
    assert index.bytes_per_vector() == 3 and index.total_bytes() == 12 and index.cluster_stats().first()["empty_clusters"] in (0, 1)
    assert result(index.search(table(spark, [MIRRORED[0]], Q), 2, 2))[0][0][0] in (0, 1)
    four = IVFPQIndex.build(table(spark, UNIT4), IVFPQConfig(4, 2, 2, 2))
    q = table(spark, [UNIT4[0]], Q)
    assert result(four.search(q, 2, 2))[0][0][0] == result(ExactIndex(4, table(spark, UNIT4)).search(q, 2))[0][0][0]
    for k, p in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            four.search(q, k, p)
    with pytest.raises(ValueError):
        four.search(table(spark, [(0, 0, 0, 0)], Q), 1)
    with pytest.raises(ValueError):
        IVFPQIndex.build(table(spark, [*UNIT4, (0, 0, 0, 0)]), IVFPQConfig(4, 2, 2, 2))
    with pytest.raises(ValueError):
        IVFPQConfig(5, 2, 2)
    assert IVFPQIndex.build(table(spark, UNIT4), IVFPQConfig(4, 2, 2, 2, max_iterations=0)).size == 4


def test_hnsw_wide_beam_is_exact(spark):
    base, q = table(spark, RING), table(spark, RING_QUERIES, Q)
    index = HNSWIndex.build(base, HNSWConfig(2))
    assert index.stats().first()["unreachable"] == 0
    assert result(index.search(q, 3, 8)) == result(ExactIndex(2, base).search(q, 3))
    assert index.search(q, 0).count() == 0
    with pytest.raises(ValueError):
        index.search(q, 9, 8)
    with pytest.raises(ValueError):
        index.search(table(spark, [(0, 0)], Q), 1)
    for bad in (dict(dims=0), dict(dims=2, m=1), dict(dims=2, ef_construction=0)):
        with pytest.raises(ValueError):
            HNSWConfig(**bad)


def test_hnsw_recall_work_and_shards(spark):
    base, q = table(spark, gaussian(5000, 16, 21)), table(spark, gaussian(20, 16, 22), Q)
    exact = ExactIndex(16, base).search(q, 10)
    one, three = (HNSWIndex.build(base, HNSWConfig(16, 16, 80, num_shards=n)) for n in (1, 3))
    found = one.search(q, 10, 100).persist()
    assert E.mean_recall(exact, found, q) >= 0.95
    work = one.search(q, 10, 32).agg({"distance_computations": "avg", "*": "count"}).first()["avg(distance_computations)"]
    assert 0 < work < 5000 / 5
    assert E.mean_recall(exact, three.search(q, 10, 100), q) >= 0.95
    again = HNSWIndex.build(base.repartition(6), HNSWConfig(16, 16, 80, num_shards=1))
    assert again.stats().first() == one.stats().first() and result(again.search(q, 10, 100)) == result(found)


def test_rows_inserted_into_a_built_graph(spark):
    x = gaussian(900, 16, 7)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    first, rest = spark.createDataFrame(rows[:500], V), spark.createDataFrame(rows[500:], V)
    q = table(spark, gaussian(20, 16, 12), Q)
    for shards in (1, 3):
        cfg = HNSWConfig(16, 16, 80, num_shards=shards)
        whole, grown = HNSWIndex.build(table(spark, x), cfg), HNSWIndex.build(first, cfg).add(rest)
        # insertion in order of identifier: the same graph as built at once
        assert grown.size == 900 and grown.stats().first() == whole.stats().first() and result(grown.search(q, 10, 60)) == result(whole.search(q, 10, 60))
    small = HNSWIndex.build(first, HNSWConfig(16, num_shards=1))
    with pytest.raises(ValueError):
        small.add(table(spark, [[0.0] * 16]))
    assert small.size == 500


def test_graph_finds_every_stored_vector_and_counts_bytes(spark):
    x = gaussian(1000, 16, 7)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = LayeredGraph(16, 16, 60)
    for i, v in enumerate(x):
        g.add(v, int(i % 17 == 0) + int(i % 289 == 0))
    for i in range(0, 1000, 10):
        near, _ = g.search(x[i], 10, 50)
        assert near[0][1] == i and abs(near[0][0]) < 1e-5 and near == sorted(near)
    assert g.unreachable() == 0
    assert HNSWIndex.build(table(spark, [UNIT4[0]]), HNSWConfig(4)).stats().first()["payload_bytes"] == 16
    assert HNSWIndex.build(table(spark, UNIT4[:2]), HNSWConfig(4)).stats().first()["payload_bytes"] >= 40


def test_unreachable_by_joins(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 4), (4, 3)], "src long, dst long")
    assert count_unreachable(spark.range(5), edges, spark.createDataFrame([(0,)], "id long")) == 3


def test_evaluation(spark):
    exact = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "query_id long, id long")
    approx = spark.createDataFrame([(0, 2), (0, 9)], "query_id long, id long")
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id long")
    assert {r["query_id"]: r["recall"] for r in E.recall_at_k(exact, approx, q).collect()} == {0: 0.5, 1: 0.0, 2: 1.0}
    s = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0)], "x double").agg(E.middle_median("x"), E.upper_median("x")).first()
    assert tuple(s) == (2.5, 3.0)
    assert E.compression_ratio(50, 25) == 8 and E.positive("12") == 12
    for bad in ("-1", "0", " 1", "+1", "1.5", "", "x"):
        with pytest.raises(Exception):
            E.positive(bad)
    with pytest.raises(ValueError):
        E.qps_samples(lambda: q, 0, 1)
    report = E.evaluate(table(spark, RING), table(spark, RING_QUERIES, Q), 2, 2, [("exact",), ("ivf", IVFConfig(2, 2), [1, 2, 9]), ("pq", PQConfig(2, 2, 4))]).collect()
    assert [r["method"] for r in report] == ["exact", "ivf", "ivf", "pq"] and report[0]["recall"] == 1
