"""Top N items within every group, with one tie rule everywhere.

Exact group counts split the input. Light groups (at most ``heavy_rows`` rows, so bounded in one
task) are hash-partitioned by group once; duplicate removal and ranking both run on that one
partitioning. Heavy groups are first reduced to one row per item (hashed by group and item, so a
hot group is spread), then range-sorted by (group, score, item); the range partition is the salt:
their number grows with the heavy rows, and each keeps the N best of every group it holds part of, and a last window over these few
rows decides. Nothing is dropped but rows that cannot rank.

Tie rule: higher score first, then lower item.

Defined cases
    * rows with a null group, item or score, a NaN score, or one outside ``[low, high]`` do not count;
    * an item repeated in a group counts once, with its highest score;
    * groups with fewer than N items give all of them; an empty table gives no rows;
    * other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of heavy groups to a range partition at most, and salts of their keys where the keys are too many to send.
RANGE_ROWS = 1_000_000
SALTS = 64


def top_n(
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int,
    *,
    low: float = float("-inf"),
    high: float = float("inf"),
    heavy_rows: int = 50_000,
    broadcast_groups: int = 100_000,
) -> DataFrame:
    """Rows ``(group, rank, item, score)`` with rank from 1 to at most ``n``."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where(
        F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & (F.col("s") >= low) & (F.col("s") <= high)
    )
    best = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())

    def ranked(x: DataFrame) -> DataFrame:
        return x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("g", "rank", "i", "s")

    heavy = rows.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > heavy_rows)
    some = heavy.limit(broadcast_groups + 1).collect()
    if len(some) <= broadcast_groups:  # a proven bound: at most broadcast_groups keys
        many = sum(r["c"] for r in some)
        on, side = ["g"], F.broadcast(df.sparkSession.createDataFrame([(r["g"],) for r in some], heavy.select("g").schema))
    else:  # the keys are salted, so the rows of a hot group do not meet in one task
        many = heavy.agg(F.sum("c")).first()[0]
        on, side = ["g", "salt"], heavy.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)))
    light = rows.join(side, on, "left_anti") if some else rows
    light = ranked(light.repartition("g").groupBy("g", "i").agg(F.max("s").alias("s")))
    if not some:
        out = light
    else:
        hot = rows.join(side, on, "left_semi").groupBy("g", "i").agg(F.max("s").alias("s"))
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(many / RANGE_ROWS))
        hot = hot.repartitionByRange(parts, F.col("g"), F.col("s").desc(), F.col("i")).withColumn("salt", F.spark_partition_id())
        local = Window.partitionBy("g", "salt").orderBy(F.col("s").desc(), F.col("i").asc())
        hot = hot.withColumn("r", F.row_number().over(local)).where(F.col("r") <= n).select("g", "i", "s")
        out = light.unionByName(ranked(hot))
    return out.select(F.col("g").alias(group), "rank", F.col("i").alias(item), F.col("s").alias(score))
