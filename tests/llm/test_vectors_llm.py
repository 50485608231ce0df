import numpy as np
import pytest

from sparvec.llm.clusters import cluster_stats, describe_clusters, pivot_rounds, similarity_clusters
from sparvec.llm.graph import Graph
from sparvec.llm.neighbours import collapsed_copies, distinct_records, exact_neighbours, most_similar, neighbour_pairs, pair_reach
from sparvec.llm.subset import lazy_greedy, objective, varied_subset
from sparvec.llm.units import Cells, distinct_units, fit_cells, packed, spherical_kmeans, unit_block, unpacked

SCHEMA = "vec_id long, vector array<float>, id long, u string, c int, n long"


def unit(x):
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 5, "x", 1, 1) for i, v in zip(ids, x)], SCHEMA)


def grouped(groups, size, noise, d, seed=0, spread=0.1):
    rng = np.random.default_rng(seed)
    c = unit(rng.standard_normal((groups, d)))
    x = np.concatenate([unit(c[g] + spread * rng.standard_normal((size * (1 + 4 * (g == 0)), d))) for g in range(groups)] + [unit(rng.standard_normal((noise, d)))])
    label = np.concatenate([np.full(size * (1 + 4 * (g == 0)), g) for g in range(groups)] + [np.full(noise, -1)])
    return x, label


DIRT = [None, [], [1.0], [0.0] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [None] + [1.0] * 19]


def test_units():
    import pyarrow as pa

    good = [[3.0, 4.0], None, [0.0, 0.0], [1e-30, 0.0], [3e38, 3e38], [None, 1.0], [1.0]]
    ids, x = unit_block(pa.array([0, 1, 2, 3, 4, 5, 6]), pa.array(good, pa.list_(pa.float32())), 2)
    assert ids.tolist() == [0, 3, 4] and np.allclose(x, [[0.6, 0.8], [1, 0], [2**-0.5, 2**-0.5]])
    assert np.array_equal(unpacked(packed(x), 2), x) and np.array_equal(unpacked(packed(x).slice(1), 2), x[1:])
    assert unpacked(packed(x[:0]), 2).shape == (0, 2)


def test_cells_route_to_the_nearest():
    x, _ = grouped(5, 40, 0, 20)
    c = spherical_kmeans(x, 5, 5, 1)
    flat = Cells(c, c, np.arange(6))
    s = x @ c.T
    assert np.array_equal(flat.home(x), s.argmax(axis=1)) and np.array_equal(np.sort(flat.near(x, 5)), np.tile(np.arange(5), (len(x), 1)))
    near = flat.near(x, 3, 0.2)
    for i in range(len(x)):
        gap = (s[i].max() - s[i]) / np.maximum(np.linalg.norm(c - c[s[i].argmax()], axis=1), 1e-9)
        want = [j for j in np.argsort(gap) if gap[j] <= 0.2][:3]
        assert near[i][near[i] >= 0].tolist() == want
    assert flat.near(x[:0], 3).shape == (0, 3)


def test_cells_grow_with_the_rows_and_a_record_asks_as_many(spark, monkeypatch):
    import sparvec.llm.units as U

    monkeypatch.setattr(U, "ONE_LEVEL", 4)
    x, _ = grouped(20, 60, 2000, 20, 7)
    units = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, u binary")
    some = fit_cells(units, 20, len(x), 150)
    many = fit_cells(units, 20, len(x), 30)
    assert 15 <= some.total <= 40 and 80 <= many.total <= 160 and len(many.first) == len(many.top) + 1
    for cells in (some, many):
        home = cells.home(x)
        near = cells.near(x, 3)
        assert np.array_equal(near[:, 0], home) and (near >= 0).all() and all(len(set(r)) == 3 for r in near.tolist())
        assert np.bincount(home, minlength=cells.total).max() < 12 * len(x) / cells.total
    # the number asked does not depend on the number of cells: 200 thousand to a billion rows in cells of 16,384
    rng = np.random.default_rng(0)
    q = unit(rng.standard_normal((500, 50)))
    asked = []
    for k in (12, 61_036):
        regions = k if k <= 64 else 248
        top = unit(rng.standard_normal((regions, 50)))
        if regions == k:
            cells = Cells(top, top, np.arange(k + 1))
        else:
            sub = unit(np.repeat(top, 246, axis=0) + 0.1 * rng.standard_normal((regions * 246, 50))).astype(np.float32)
            cells = Cells(top, sub, np.arange(regions + 1) * 246)
        asked.append((cells.near(q, 3) >= 0).sum(axis=1).mean())
        assert ((cells.near(q, 3, pair_reach(0.95, 50)) >= 0).sum(axis=1) <= 3).all()
    assert asked == [3.0, 3.0]


def plain_greedy(x, k, saturation, background):
    s = x @ x.T
    demand = (1 - background) / np.maximum(np.maximum(s - background, 0).sum(axis=1), 1 - background)
    s = np.clip(s, 0, saturation)
    cover, out = np.zeros(len(x)), []
    for _ in range(k):
        gain = (np.maximum(s - cover, 0) * demand).sum(axis=1)
        gain[out] = -1
        out.append(int(gain.argmax()))
        cover = np.maximum(cover, s[out[-1]])
    return out


def test_lazy_greedy_equals_greedy():
    x, _ = grouped(4, 12, 25, 16, 3)
    at, gains, stood = lazy_greedy(x, 15, 0.5)
    assert len(stood) == 15 and (stood > 0).all()
    assert at == plain_greedy(x, 15, 0.5, 0.3) and all(a >= b - 1e-5 for a, b in zip(gains, gains[1:]))
    assert lazy_greedy(x[:0], 3, 0.5)[:2] == ([], []) and len(lazy_greedy(x, 500, 0.5)[0]) == len(x)


def test_subset_covers_groups_and_sparse_regions(spark):
    x, label = grouped(10, 40, 150, 60, 5)
    df = table(spark, [*x, *DIRT, *x[:30]], [*range(len(x)), *range(9000, 9000 + len(DIRT)), *range(30)])
    run = lambda d: [r["vec_id"] for r in varied_subset(d, 60, dims=60, partition_rows=128, final_rows=400).orderBy("place").collect()]
    got = run(df)
    assert len(got) == len(set(got)) == 60 and max(got) < len(x)
    chosen = label[got]
    assert set(range(10)) <= set(chosen.tolist()) and (chosen == 0).sum() < 15 and (chosen == -1).sum() > 20
    assert run(df.repartition(5)) == got
    assert run(df.where("false")) == [] and len(run(df.where("vec_id < 7"))) == 7
    with pytest.raises(ValueError):
        varied_subset(df, 0)
    large = [r["vec_id"] for r in varied_subset(df, 200, dims=60, partition_rows=256, final_rows=128).collect()]
    assert len(large) == len(set(large)) == 200 and max(large) < len(x) and set(range(10)) <= set(label[large].tolist())
    # near a central greedy pass over all records, and above a random subset
    mass = np.maximum(x @ x.T - 0.3, 0).sum(axis=1)
    demand = 0.7 / np.maximum(mass, 0.7)
    central = x[lazy_greedy(x, 60, 0.5)[0]]
    by_chance = np.mean([objective(x, x[np.random.default_rng(i).choice(len(x), 60, replace=False)], demand) for i in range(5)])
    ours = objective(x, x[got], demand)
    assert ours >= 0.95 * objective(x, central, demand) and ours > by_chance


def test_pivots_are_hash_minima():
    x, _ = grouped(3, 10, 20, 20, 1)
    order = np.random.default_rng(0).permutation(len(x))
    want = np.full(len(x), -1)
    for i in np.argsort(order):
        if want[i] < 0:
            near = (x @ x[i] >= 0.5) & (want < 0)
            want[near] = i
            want[i] = i
    got = pivot_rounds(x, order, 0.5, batch=1)
    assert np.array_equal(got, want)
    assert len(np.unique(pivot_rounds(x, order, 0.5, batch=16))) <= len(np.unique(want)) + 3


def test_clusters_are_recovered(spark):
    x, label = grouped(8, 30, 300, 40, 2)
    ids = np.random.default_rng(1).permutation(len(x)) + 100
    rows = [*x * np.random.default_rng(3).uniform(0.1, 50, (len(x), 1)), *DIRT, *x[:40]]
    df = table(spark, rows, [*ids, *range(9000, 9000 + len(DIRT)), *ids[:40]])
    for bounds in ({}, {"cell_rows": 200}, {"cell_rows": 200, "centre_block": 3, "near_cells": 4, "merge_rows": 6}):
        members, proposed = similarity_clusters(df, dims=40, **bounds)
        got = {}
        for r in members.collect():
            got.setdefault(r["group_id"], set()).add(r["id"])
        want = {int(ids[label == g].min()): set(ids[label == g].tolist()) for g in range(8)}
        assert got == want and proposed >= 8
    told = {r["group_id"]: r for r in describe_clusters(members).collect()}
    assert {k: v["size"] for k, v in told.items()} == {k: len(v) for k, v in want.items()} and all(len(r["medoids"]) == 5 for r in told.values())
    s = cluster_stats(members, proposed).first()
    assert s["max_size"] == 150 and s["min_size"] == 30 and s["empty_clusters"] == proposed - 8


def scattered(rows, few, size, cells_of, d=50, seed=5):
    """Half of the rows in large groups, ``few`` groups of ``size`` at a cosine of about 0.72 to their mean, the rest anywhere."""
    rng = np.random.default_rng(seed)
    big = unit(rng.standard_normal((cells_of, d)))
    x = [unit(big[rng.integers(0, cells_of, rows // 2)] + 0.09 * rng.standard_normal((rows // 2, d)))]
    c = unit(rng.standard_normal((few, d)))
    x.append(unit(np.repeat(c, size, axis=0) + 0.135 * rng.standard_normal((few * size, d))))
    x.append(unit(rng.standard_normal((rows - rows // 2 - few * size, d))))
    return np.concatenate(x), [range(rows // 2 + g * size, rows // 2 + (g + 1) * size) for g in range(few)]


def arrow_table(spark, x):
    import pyarrow as pa

    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "vector": flat}))


def test_small_clusters_scattered_over_cells_are_found(spark):
    x, few = scattered(16_000, 20, 16, 20)
    members, _ = similarity_clusters(arrow_table(spark, x), cell_rows=256)
    owner = {r["id"]: r["group_id"] for r in members.collect()}
    there = together = 0
    for g in few:
        m = unit(x[g.start : g.stop].mean(axis=0)[None])[0]
        close = [owner.get(i) for i in g if x[i] @ m >= 0.65]
        there += len(close)
        together += max(sum(o == k for o in close) for k in {*close, -1} - {None})
    assert together >= 0.85 * there  # 0.66 where nothing looks at the unclustered records again


def test_a_cell_of_many_pivots_takes_bounded_memory():
    import tracemalloc

    from sparvec.llm.clusters import cell_pivots

    rng = np.random.default_rng(4)
    x = unit(np.repeat(rng.standard_normal((6_000, 20)), 3, axis=0) + 0.02 * rng.standard_normal((18_000, 20)))
    tracemalloc.start()
    pivot, _, _ = cell_pivots(np.arange(len(x)), x, 0.9, 0.9, 3, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pivot) > 3_000 and peak < 100e6  # 866 MB where all cosines are held at once


def test_many_groups_meet_records_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from sparvec.llm.clusters import _members

    rng = np.random.default_rng(4)
    x, g = unit(rng.standard_normal((10_000, 50))), unit(rng.standard_normal((8_192, 50)))
    g[:5_000] = x[:5_000]
    tracemalloc.start()
    b = _members(0.9)(pa.array(range(len(x))), x, [(np.arange(a, a + 4_096), np.stack([g[a : a + 4_096]] * 2, axis=1), np.ones(4_096)) for a in (0, 4_096)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b.column(1).to_pylist()[:5_000] == list(range(5_000)) and b.column(1).null_count == 5_000 == 10_000 - b.column(3).null_count and peak < 60e6


def test_clusters_do_not_depend_on_the_number_of_groups(spark):
    """More groups than one block or one joining task holds: the same members."""
    x, _ = scattered(4_000, 12, 20, 16)
    df = arrow_table(spark, x)
    got = []
    for bounds in ({}, {"centre_block": 3, "near_cells": 1, "merge_rows": 4}):
        members, proposed = similarity_clusters(df, cell_rows=256, **bounds)
        got.append((sorted(map(tuple, members.collect())), proposed))
    assert got[0] == got[1] and len({g for g, _, _ in got[0][0]}) > 16


def test_leaders_are_the_same_in_one_task_and_in_many(spark):
    from sparvec.llm.clusters import _far_leaders, _leaders

    rng = np.random.default_rng(8)
    c, n = rng.permutation(300) * 7, rng.integers(1, 5, 300)
    a, b = rng.integers(0, 300, (2, 500))
    up = (n[b] > n[a]) | (n[b] == n[a]) & (c[b] < c[a])
    low, high, cos = c[a[up]], c[b[up]], np.round(0.8 + 0.2 * rng.random(up.sum()), 1)
    near = {}
    for p, q, s in zip(low.tolist(), high.tolist(), cos.tolist()):
        near.setdefault(p, []).append((-s, q))
    want = {}
    for k in sorted(c.tolist(), key=lambda k: (-n[c == k][0], k)):
        led = sorted(e for e in near.get(k, []) if want[e[1]] == e[1])
        want[k] = led[0][1] if led else k
    assert dict(zip(c.tolist(), _leaders(c, n, low, high, cos).tolist())) == want
    pairs = spark.createDataFrame(list(zip(low.tolist(), high.tolist(), cos.tolist())), "low long, high long, cos double")
    assert {r["low"]: r["leader"] for r in _far_leaders(pairs).collect()} == {k: v for k, v in want.items() if k != v}
    assert _far_leaders(pairs.where("false")).count() == 0


def test_clusters_of_nothing(spark):
    for df in (table(spark, DIRT), table(spark, DIRT).where("false"), table(spark, [[1.0] * 20])):
        members, proposed = similarity_clusters(df, dims=20)
        assert members.count() == 0 and cluster_stats(members, proposed).first()["max_size"] == 0


def test_graph_recall_and_prune():
    x, _ = grouped(10, 60, 800, 20, 4)
    g = Graph(x, degree=16, beam=32)
    ids, dist = g.search(x, 32, start=np.arange(len(x)))
    truth = np.argsort(-(x @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth, ids[:, :12])]) > 0.95
    assert (np.diff(np.where(np.isfinite(dist), dist, 9), axis=1) >= -1e-6).all() and g.work > 0
    for n in (0, 1, 2, 3):
        small = Graph(x[:n])
        if n:
            assert set(small.search(x[:n], 5)[0].ravel()) - {-1} == set(range(n))


def test_neighbours_against_brute_force(spark):
    x, _ = grouped(10, 30, 600, 20, 6)
    x[700:720] = unit(x[100:120] + 0.02 * np.random.default_rng(0).standard_normal((20, 20)))
    df = table(spark, [*x, *DIRT, *x[:25]], [*range(len(x)), *range(9000, 9000 + len(DIRT)), *range(25)])
    found = most_similar(df, 5, dims=20, shard_rows=400, probes=3, degree=20, beam=48).persist()
    rows = found.collect()
    assert all(r["query_id"] != r["id"] and 1 <= r["rank"] <= 5 for r in rows) and len({(r["query_id"], r["id"]) for r in rows}) == len(rows)
    records = distinct_records(df, dims=20)
    exact = exact_neighbours(records, records, 5, 20, block=300)
    want = {(r["query_id"], r["id"]) for r in exact.collect()}
    assert len(want) == 5 * len(x)
    assert len(want & {(r["query_id"], r["id"]) for r in rows}) / len(want) >= 0.9
    pairs = {(r["vec_id_a"], r["vec_id_b"]) for r in neighbour_pairs(most_similar(df, 5, least_cos=0.95, dims=20, shard_rows=400, probes=2, degree=12, beam=8)).collect()}
    truth = {(min(a, b), max(a, b)) for a, b in want if x[a].astype(float) @ x[b].astype(float) >= 0.95}
    assert len(truth) >= 15 and pairs <= truth and len(pairs) >= 0.95 * len(truth)


def test_close_pairs_across_cells_are_found(spark):
    rng = np.random.default_rng(8)
    x = unit(rng.standard_normal((2000, 50)))
    x = np.concatenate([x, unit(x + 0.035 * rng.standard_normal(x.shape))])
    found = most_similar(arrow_table(spark, x), 10, least_cos=0.95, shard_rows=100, probes=3, degree=12, beam=8)
    pairs = {(r["vec_id_a"], r["vec_id_b"]) for r in neighbour_pairs(found).collect()}
    truth = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9501, 1)))}
    assert len(truth) > 1000 and len(truth & pairs) >= 0.995 * len(truth)


def test_exact_copies_by_the_tie_rule(spark):
    x = unit(np.random.default_rng(2).standard_normal((60, 20)))
    rows = [*x, *[2.0 * x[7]] * 40, x[7] * 4]  # forty-two copies of one direction
    df = table(spark, [np.float32(v) for v in rows])
    got = {}
    for r in most_similar(df, 3, dims=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 5)))
    copies = [7, *range(60, 101)]
    same = [i for i in copies if unit(np.float32(rows[i])[None].astype(float)).tobytes() == x[7].tobytes()]
    assert len(same) >= 40
    for i in same:
        assert [j for _, j, _ in sorted(got[i])] == [j for j in same if j != i][:3]


def test_copies_collapse_wherever_they_lie(spark):
    x = unit(np.random.default_rng(3).standard_normal((40, 20)))
    rows = [(i, x[i % 40 if i % 3 else 5].tobytes()) for i in range(900)]
    rows += rows[:100]  # delivered again
    units = spark.createDataFrame(rows, "id long, u binary").repartition(7)
    got = {bytes(r["u"]): (r["ids"], r["more"]) for r in collapsed_copies(units, 4, 20).collect()}
    want = {}
    for i, u in rows:
        want.setdefault(u, set()).add(i)
    assert got == {u: (sorted(v)[:4], len(v) > 4) for u, v in want.items()}
    assert sorted(r["id"] for r in distinct_units(units).collect()) == list(range(900))


def test_neighbours_of_nothing(spark):
    assert most_similar(table(spark, DIRT), 3, dims=20).count() == 0
    assert most_similar(table(spark, DIRT).where("false"), 3, dims=20).count() == 0
    assert most_similar(table(spark, [[1.0] * 20]), 3, dims=20).count() == 0
    with pytest.raises(ValueError):
        most_similar(table(spark, DIRT), 0)
