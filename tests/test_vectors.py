import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvec.functions import vectors as V

SCHEMA = "id long, vector array<float>"


def test_expressions_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((20, 7)).astype(np.float32), rng.standard_normal((20, 7)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "id long, a array<float>, b array<float>")
    rows = df.select("id", V.dot(F.col("a"), F.col("b")).alias("d"), V.squared_l2(F.col("a"), F.col("b")).alias("l"), V.normalize(F.col("a")).alias("n"), V.subvector(F.col("a"), 1, 3).alias("s"), V.residual(F.col("a"), F.col("b")).alias("r")).orderBy("id").collect()
    for r, x, y in zip(rows, a.astype(float), b.astype(float)):
        assert r["d"] == pytest.approx(x @ y) and r["l"] == pytest.approx(((x - y) ** 2).sum())
        assert np.linalg.norm(r["n"]) == pytest.approx(1, abs=1e-6)
        assert r["s"] == [np.float32(v) for v in x[3:6]] and np.allclose(r["r"], x - y, atol=1e-6)


def test_unequal_lengths_give_null_and_zero_vectors_no_direction(spark):
    r = spark.createDataFrame([([1.0, 2.0], [1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(V.dot(F.col("a"), F.col("b")).alias("d"), V.normalize(F.col("z")).alias("n")).first()
    assert r["d"] is None and r["n"] is None


def test_tiny_and_huge_vectors_are_normalized(spark):
    rows = spark.createDataFrame([(0, [1e-30, 0.0]), (1, [1e20, 1e20])], SCHEMA).select(V.normalize(F.col("vector")).alias("n")).collect()
    assert rows[0]["n"] == [1.0, 0.0] and rows[1]["n"] == pytest.approx([0.7071068, 0.7071068])


def test_validation_names_every_flaw(spark):
    bad = [(0, None), (1, [1.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(bad, SCHEMA)
    got = {r["flaw"]: r["n"] for r in V.validation_report(df, "vector", 2).collect()}
    assert got == {"null_vector": 1, "wrong_length": 1, "null_component": 1, "not_finite": 2, "zero_norm": 1, "valid": 1}
    with pytest.raises(ValueError, match="zero_norm"):
        V.check_vectors(df, "vector", 2)
    assert V.check_vectors(df.where("id = 6"), "vector", 2) == 1


def test_hash_order_does_not_depend_on_partitioning(spark):
    df = spark.range(200)
    a = [r["id"] for r in V.sample_by_hash(df.repartition(1), "id", 20).collect()]
    assert a == [r["id"] for r in V.sample_by_hash(df.repartition(7), "id", 20).collect()] and len(set(a)) == 20
    u = [r["u"] for r in df.select(V.hash_uniform(1, F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and 0.4 < np.mean(u) < 0.6
