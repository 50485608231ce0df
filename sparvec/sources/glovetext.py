"""Embedding text files: a term and its values per line, separated by white space.

Strict form of the vocabulary loader: the first malformed line is an error that names its number.
The file is read and checked in parallel; only the number of the first bad line is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_embedding_text(spark: SparkSession, path: str, dims: int, limit: int) -> DataFrame:
    """``(id, term, vector)`` of the first ``limit`` embeddings; ``id`` counts them from 0. Blank lines are skipped.

    ``path`` names one file, whose partitions are numbered in order; for many files, or tolerant
    loading, see ``badrows``.
    """
    if dims < 1 or limit < 1:
        raise ValueError("dims and limit must be positive")
    lines = spark.read.option("lineSep", "\n").text(path)
    # (partition, row in partition) numbers the lines: one small row per partition is gathered
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    placed = placed.select("value", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    sizes = {r["part"]: (r["n"], r["full"]) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(_full(F.col("value"))).alias("full")).collect()}
    starts, at, ids = {}, 0, 0
    for p in sorted(sizes):
        starts[p] = (at, ids)
        at, ids = at + sizes[p][0], ids + sizes[p][1]
    base = F.create_map(*[F.lit(x) for p, (n, _) in starts.items() for x in (p, n)]) if starts else F.create_map()
    fields = placed.where(_full(F.col("value"))).select(
        (F.element_at(base, F.col("part")) + F.col("row")).alias("number") if starts else F.col("row").alias("number"),
        F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("f"),
    )
    rows = fields.select(
        "number", F.col("f")[0].alias("term"), F.size("f").alias("n"), F.expr("transform(slice(f, 2, size(f)), x -> try_cast(x as float))").alias("vector")
    )
    first = rows.orderBy("number").limit(limit) if limit < ids else rows
    bad = first.where((F.col("n") != dims + 1) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    worst = bad.agg(F.min("number")).first()[0]
    if worst is not None:
        raise ValueError(f"{path}: line {worst + 1} is not a term and {dims} numbers")
    # the id is the line number less the blank lines before it
    blanks = placed.where(~_full(F.col("value"))).select((F.element_at(base, F.col("part")) + F.col("row")).alias("b")) if starts else None
    gaps = [r["b"] for r in blanks.orderBy("b").limit(MOST_BLANKS + 1).collect()] if blanks is not None else []
    if len(gaps) > MOST_BLANKS:
        raise ValueError(f"{path}: more than {MOST_BLANKS} blank lines")
    before = F.size(F.filter(F.array(*[F.lit(g).cast("long") for g in gaps]), lambda g: g < F.col("number"))) if gaps else F.lit(0)
    return first.select((F.col("number") - before).cast("long").alias("id"), "term", "vector")


MOST_BLANKS = 10_000


def _full(value: Column) -> Column:
    return value.rlike(r"\S")
