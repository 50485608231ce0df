"""Cutting lineage through tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a
local master gets a temporary folder (one machine, so nothing can be out of reach); any other
master is refused, because a machine-local folder would be lost with its executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="sparvec-")
    return _local[app]


def cut(df: DataFrame, name: str = "cut", folders: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in ``folders`` by these columns, and read it back: the plan behind it ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparvec/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``rows`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
