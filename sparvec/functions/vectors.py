"""Vector expressions as columns, all JVM-side, and their validation.

Components are float32 at rest; sums run in double, left to right. A unit vector is rounded back to
float32, so that later sums of it do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if the lengths differ."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column) -> Column:
    """The unit vector; null for a vector without direction."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def subvector(v: Column, m: int, width: int) -> Column:
    """Sub-vector ``m`` (from 0) of ``width`` components."""
    return F.slice(v, m * width + 1, width)


def residual(v: Column, c: Column) -> Column:
    """``v - c`` in float32."""
    return F.zip_with(v, c, lambda x, y: (x.cast("double") - y.cast("double")).cast("float"))


def flaw(v: Column, dims: int) -> Column:
    """Why a vector cannot be indexed, or null."""
    return (
        F.when(v.isNull(), "null_vector")
        .when(F.size(v) != dims, "wrong_length")
        .when(F.exists(v, lambda x: x.isNull()), "null_component")
        .when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(~F.exists(v, lambda x: x != 0), "zero_norm")
    )


def validation_report(df: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """``(flaw, n)``: the count of every kind of flaw; valid rows count as ``valid``."""
    return df.groupBy(F.coalesce(flaw(F.col(vector_col), dims), F.lit("valid")).alias("flaw")).agg(F.count("*").alias("n"))


def check_vectors(df: DataFrame, vector_col: str, dims: int) -> int:
    """The number of rows; raises ``ValueError`` naming the flaws if there are any. One aggregate."""
    counts = {r["flaw"]: r["n"] for r in validation_report(df, vector_col, dims).collect()}
    valid = counts.pop("valid", 0)
    if counts:
        raise ValueError("vectors that cannot be indexed: " + ", ".join(f"{k} {v}" for k, v in sorted(counts.items())))
    return valid


def hash_order(seed: int, *keys: Column) -> Column:
    """A deterministic, engine-independent shuffle key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_uniform(seed: int, key: Column) -> Column:
    """A uniform in [0, 1) from 52 bits of the hash."""
    return F.conv(F.substring(hash_order(seed, key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def first_by_hash(df: DataFrame, order: Column, id_col: str, n: int, rows: int | None = None) -> DataFrame:
    """The first ``n`` rows by a hash. ``rows``: how many there are, if known.

    A limit behind a sort gathers ``n`` rows of every partition in one task. Where the rows are
    known to be many, only hashes that low are let through to it: about 4 n + 64 rows in all, so
    that fewer than ``n`` do not occur.
    """
    if rows is not None and rows > 100 * n + 1_000:
        df = df.where(order < F.lit(f"{int((4 * n + 64) / rows * 16**12):012x}"))
    return df.orderBy(order, F.col(id_col)).limit(n)


def sample_by_hash(df: DataFrame, id_col: str, n: int, seed: int = 42, rows: int | None = None) -> DataFrame:
    """``n`` rows drawn without replacement, the same on every run and partitioning. ``rows``: how many there are, if known."""
    return first_by_hash(df, hash_order(seed, F.col(id_col)), id_col, n, rows)


def held_out_split(df: DataFrame, id_col: str, base_rows: int) -> tuple[DataFrame, DataFrame]:
    """(base, query pool): identifiers below ``base_rows`` and the rest."""
    return df.where(F.col(id_col) < base_rows), df.where(F.col(id_col) >= base_rows)
