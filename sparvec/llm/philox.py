"""Philox-2x32-10, a counter-based random generator (Salmon et al., SC 2011), as columns and as numpy.

The counter is the record's 64-bit identifier and the key the seed, so a record's number depends on
nothing else: not on its partition, its neighbours or the run. The column form splits the 32x32-bit
product into 16-bit halves so that no step overflows a BIGINT under ANSI mode, and stays JVM-side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULTIPLIER = 0xD256D193
WEYL = 0x9E3779B9
ROUNDS = 10
LOW32 = 0xFFFFFFFF


def philox_words(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The generator's two 32-bit words of each id, as uint64."""
    u = np.asarray(ids).astype(np.int64).view(np.uint64)
    a, b = u & np.uint64(LOW32), u >> np.uint64(32)
    key = seed & LOW32
    for _ in range(ROUNDS):
        p = a * np.uint64(MULTIPLIER)
        a, b = (p >> np.uint64(32)) ^ np.uint64(key) ^ b, p & np.uint64(LOW32)
        key = (key + WEYL) & LOW32
    return a, b


def philox_uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """53-bit uniforms in [0, 1)."""
    a, b = philox_words(ids, seed)
    return ((a << np.uint64(21)) | (b >> np.uint64(11))).astype(np.float64) * 2.0**-53


def philox_column(id_col: Column, seed: int) -> Column:
    """The 53-bit uniform of each id (a BIGINT; null gives null) as one expression.

    The rounds are a fold over the ten round keys: written out as nested columns, a filter on the
    result would be pushed below them by copying, and the copies would double with every round.
    """
    keys = [(seed + i * WEYL) & LOW32 for i in range(ROUNDS)]

    def turn(acc: Column, key: Column) -> Column:
        low = acc["a"].bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER)
        high = F.shiftright(acc["a"], 16) * F.lit(MULTIPLIER)
        whole = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
        top = F.shiftright(high, 16) + F.shiftright(whole, 32)
        return F.struct(top.bitwiseXOR(key).bitwiseXOR(acc["b"]).alias("a"), whole.bitwiseAND(F.lit(LOW32)).alias("b"))

    start = F.struct(id_col.bitwiseAND(F.lit(LOW32)).alias("a"), F.shiftrightunsigned(id_col, 32).alias("b"))
    done = lambda acc: F.shiftleft(acc["a"], 21).bitwiseOR(F.shiftright(acc["b"], 11)).cast("double") * F.lit(2.0**-53)
    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), start, turn, done)


def with_philox(df: DataFrame, id_col: str, seed: int, out: str = "u") -> DataFrame:
    """``df`` with the uniform of each ``id_col``."""
    return df.withColumn(out, philox_column(F.col(id_col).cast("long"), seed))


def philox_sql(source: str, id_col: str, seed: int, keep: list[str], out: str = "u") -> str:
    """The same numbers as a DuckDB query over ``source``, for checks."""
    cols = ", ".join(keep)
    sql = f"SELECT {cols}, ({id_col} & {LOW32})::BIGINT AS pa, (({id_col} >> 32) & {LOW32})::BIGINT AS pb FROM {source}"
    key = seed & LOW32
    for _ in range(ROUNDS):
        sql = f"SELECT {cols}, pb, (pa & 65535) * {MULTIPLIER} AS pl, (pa >> 16) * {MULTIPLIER} AS ph FROM ({sql})"
        sql = f"SELECT {cols}, pb, ph, pl + ((ph & 65535) << 16) AS ps FROM ({sql})"
        sql = f"SELECT {cols}, xor(xor((ph >> 16) + (ps >> 32), {key}::BIGINT), pb) AS pa, ps & {LOW32} AS pb FROM ({sql})"
        key = (key + WEYL) & LOW32
    return f"SELECT {cols}, ((pa << 21) | (pb >> 11))::DOUBLE * power(2.0::DOUBLE, -53) AS {out} FROM ({sql})"
