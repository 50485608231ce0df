import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparvec.llm.epochs import Ledger, extend_ledger, open_ledger, select_epoch_sample
from sparvec.llm.philox import philox_uniform, philox_words, with_philox
from sparvec.llm.queries import p2_stable_sample
from sparvec.llm.reservoir import fixed_size_sample, hypergeometric, sequential_selection, split_quota
from sparvec.llm.topn import top_n

# the published known answers of Philox-2x32-10
KNOWN = [((0, 0), 0, (0xFF1DAE59, 0x6CD10DF2)), ((0xFFFFFFFF, 0xFFFFFFFF), 0xFFFFFFFF, (0x2C3F628B, 0xAB4FD7AD)), ((0x243F6A88, 0x85A308D3), 0x13198A2E, (0xDD7CE038, 0xF62A4C12))]


@pytest.mark.parametrize(("counter", "key", "want"), KNOWN)
def test_philox_known_answers(counter, key, want):
    ident = np.array([counter[0] | counter[1] << 32], np.uint64).view(np.int64)
    a, b = philox_words(ident, key)
    assert (int(a[0]), int(b[0])) == want


def test_philox_columns_equal_numpy(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012]
    got = {r["id"]: r["u"] for r in with_philox(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 7).collect()}
    assert [got[i] for i in ids] == philox_uniform(np.array(ids), 7).tolist()
    assert with_philox(spark.createDataFrame([(None,)], "id long"), "id", 7).first()["u"] is None


def pieces(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, term string, piece_no int, u double, rate double, first_epoch int")


def rows_of(lo, hi, piece):
    return [(i, f"t{i}", piece, 9.0, 9.0, 9) for i in range(lo, hi)]


def test_epoch_sample_only_grows(spark):
    one, two, three = rows_of(0, 400, 0), rows_of(300, 900, 1), rows_of(0, 1500, 2)
    whole = select_epoch_sample(open_ledger(pieces(spark, one + two + three), "vec_id", "piece_no", "term", 100), "vec_id", 5).orderBy("vec_id").collect()
    ledger = open_ledger(pieces(spark, one), "vec_id", "piece_no", "term", 100)
    before = {r["vec_id"] for r in select_epoch_sample(ledger, "vec_id", 5).collect()}
    for p in (two, three):
        ledger = extend_ledger(ledger, pieces(spark, p), "vec_id", "piece_no", "term", 100)
        now = {r["vec_id"] for r in select_epoch_sample(ledger, "vec_id", 5).collect()}
        assert before <= now
        before = now
    assert before == {r["vec_id"] for r in whole} and 100 <= len(before) < 500
    again = select_epoch_sample(open_ledger(pieces(spark, (one + two + three)[::-1]).repartition(7), "vec_id", "piece_no", "term", 100), "vec_id", 5).orderBy("vec_id").collect()
    assert again == whole
    assert {r["first_epoch"] for r in whole if r["vec_id"] < 400} == {0}


def test_late_records_of_a_closed_epoch_get_its_rate(spark):
    ledger = open_ledger(pieces(spark, rows_of(0, 200, 0) + rows_of(200, 400, 1)), "vec_id", "piece_no", "term", 50)
    rate = {r["first_epoch"]: r["rate"] for r in ledger.select("first_epoch", "rate").distinct().collect()}
    later = extend_ledger(ledger, pieces(spark, rows_of(1000, 1010, 0)), "vec_id", "piece_no", "term", 50)
    assert {r["rate"] for r in later.where("vec_id >= 1000").collect()} == {rate[0]} and later.count() == 410


def test_the_query_keeps_its_choices_when_a_lower_piece_arrives_late(spark, tmp_path):
    table = str(tmp_path / "glove_embeddings.parquet")
    pieces(spark, rows_of(0, 1000, 1) + rows_of(1000, 3000, 2)).write.parquet(table)
    before = {r["vec_id"] for r in p2_stable_sample(spark, str(tmp_path)).collect()}
    assert before == {r["vec_id"] for r in p2_stable_sample(spark, str(tmp_path)).collect()}
    pieces(spark, rows_of(3000, 6000, 0) + rows_of(6000, 7000, 3)).write.mode("append").parquet(table)
    now = {r["vec_id"] for r in p2_stable_sample(spark, str(tmp_path)).collect()}
    assert before <= now and len(now) > len(before) > 500


def test_replay_in_order_of_arrival_loses_nothing(spark, small, tmp_path):
    """A ledger opened anew for each part of the arrivals, as a restarted job would."""
    rows = spark.read.parquet(f"{small}/glove_embeddings.parquet").select("vec_id", "term", "piece_no", F.coalesce(F.unix_timestamp("loaded_at"), F.lit(2**40)).alias("t")).persist()
    marks = [r[0] for r in rows.selectExpr("explode(percentile_approx(t, array(0.2, 0.5, 0.8, 0.95, 1.0), 100000))").collect()]
    before, low = set(), -1
    for mark in marks:
        ledger = Ledger(spark, str(tmp_path / "ledger"), "vec_id", "piece_no", "term", 100)
        now = {r["vec_id"] for r in ledger.extend(rows.where((F.col("t") > low) & (F.col("t") <= mark)).drop("t")).sample(42).collect()}
        assert before <= now
        before, low = now, mark
    assert len(before) > 100
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path / "none"), "vec_id", "piece_no", "term", 100).sample(1)


def test_epoch_sample_cases(spark):
    df = pieces(spark, [(None, "x", 0, 0.0, 0.0, 0), (1, None, None, 0.0, 0.0, 0), (2, None, 1, 0.0, 0.0, 0), (2, "b", 1, 0.0, 0.0, 0), (2, "a", 0, 0.0, 0.0, 0), (3, None, 3, 0.0, 0.0, 0)])
    got = {r["vec_id"]: (r["term"], r["first_epoch"], r["rate"]) for r in open_ledger(df, "vec_id", "piece_no", "term", 10).collect()}
    assert got == {2: ("a", 0, 1.0), 3: (None, 3, 1.0)}
    assert open_ledger(df.where("false"), "vec_id", "piece_no", "term", 10).count() == 0
    with pytest.raises(ValueError):
        open_ledger(df, "vec_id", "piece_no", "term", 0)


def test_hypergeometric_matches_its_distribution():
    u = (np.arange(4000) + 0.5) / 4000
    x = np.array([hypergeometric(v, 30, 50, 12) for v in u])
    assert abs(x.mean() - 12 * 30 / 80) < 0.02 and abs(x.var() - 12 * (3 / 8) * (5 / 8) * (68 / 79)) < 0.05
    assert hypergeometric(0.5, 0, 9, 4) == 0 and hypergeometric(0.5, 9, 0, 4) == 4 and hypergeometric(0.9, 3, 3, 6) == 3
    big = [hypergeometric(v, 10**12, 3 * 10**12, 10_000) for v in (0.1, 0.5, 0.9)]
    assert all(2300 < b < 2700 for b in big)
    with pytest.raises(ValueError):
        hypergeometric(0.5, 1, 1, 3)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=20), st.integers(0, 400), st.integers(0, 99))
def test_quotas_add_up(counts, k, seed):
    q = split_quota(counts, k, seed)
    assert sum(q) == min(k, sum(counts)) and all(0 <= a <= b for a, b in zip(q, counts))


def test_selection_is_uniform():
    ids = np.arange(20)
    hits = np.zeros(20)
    for seed in range(3000):
        q = split_quota([3, 10, 7], 5, seed)
        for part, n in zip((ids[:3], ids[3:13], ids[13:]), q):
            hits[sequential_selection(part, n, seed + 1)] += 1
    assert abs(hits / 3000 - 0.25).max() < 0.035


def records(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, term string, vector array<float>, piece_no int, id long, leaf long, n long")


def test_fixed_size_sample(spark):
    rows = [(i, f"t{i}", [float(i)], i % 3 if i < 900 else 7, 0, 0, 0) for i in range(1000)] + [(i, f"t{i}", [float(i)], 9, 0, 0, 0) for i in range(0, 1000, 10)]
    draw = lambda df, k: fixed_size_sample(df, "vec_id", "piece_no", ["term", "vector"], k, seed=3, leaf_rows=64).orderBy("vec_id").collect()
    got = draw(records(spark, rows), 100)
    assert len(got) == 100 and len({r["vec_id"] for r in got}) == 100
    assert all(r["term"] == f"t{r['vec_id']}" and r["vector"] == [float(r["vec_id"])] and r["piece_no"] != 9 for r in got)
    assert draw(records(spark, rows[::-1]).repartition(5), 100) == got
    assert len(draw(records(spark, rows), 5000)) == 1000 and draw(records(spark, rows), 0) == [] and draw(records(spark, rows).where("false"), 5) == []
    many = records(spark, [(i, "t", None, i // 3, 0, 0, 0) for i in range(3000)])  # more pieces than nodes would be with fewer
    assert len({r["vec_id"] for r in draw(many, 700)}) == 700
    odd = records(spark, [(None, "x", None, 0, 0, 0, 0), (1, None, None, 0, 0, 0, 0), (2, "y", [], None, 0, 0, 0)])
    assert [r["vec_id"] for r in draw(odd, 5)] == [1]
    with pytest.raises(ValueError):
        draw(odd, -1)


def brute_top(rows, n, low, high):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s and low <= s <= high:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -9e9))
    return {(g, r + 1, i, s) for g, m in best.items() for r, (i, s) in enumerate(sorted(m.items(), key=lambda t: (-t[1], t[0]))[:n])}


@pytest.mark.parametrize("heavy", [3, 40, 10_000])
def test_top_n_against_brute_force(spark, heavy):
    rng = np.random.default_rng(heavy)
    rows = [(int(g), int(i), float(np.round(s, 1))) for g, i, s in zip(np.where(rng.random(3000) < 0.4, 3, rng.integers(0, 60, 3000)), rng.integers(0, 200, 3000), rng.normal(0, 0.6, 3000))]
    rows += [(None, 1, 0.5), (1, None, 0.5), (1, 1, None), (1, 2, float("nan")), (1, 3, float("inf")), (1, 4, float("-inf")), (1, 5, 1.5)]
    df = spark.createDataFrame([(g, i, s, 0, 0, 0.0, 0) for g, i, s in rows], "query_id long, id long, score double, g long, i long, s double, rank int")
    got = {(r["query_id"], r["rank"], r["id"], r["score"]) for r in top_n(df, "query_id", "id", "score", 5, low=-1, high=1, heavy_rows=heavy).collect()}
    assert got == brute_top(rows, 5, -1, 1)
    many = {(r["query_id"], r["rank"], r["id"], r["score"]) for r in top_n(df, "query_id", "id", "score", 5, low=-1, high=1, heavy_rows=heavy, broadcast_groups=1).collect()}
    assert many == got


def test_top_n_cases(spark):
    df = spark.createDataFrame([], "query_id long, id long, score float")
    assert top_n(df, "query_id", "id", "score", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "query_id", "id", "score", 0)
    assert F is not None
