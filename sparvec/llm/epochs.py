"""A sample that reruns reproduce and that only ever grows.

Epoch-rate selection. A record's epoch is the first in which it was seen; an epoch's rate is fixed
once, from what was known when it closed, and never changes. Both are persisted per record in a
ledger. A record is selected iff its Philox uniform, keyed by its identifier alone, lies below its
frozen rate. New pieces add ledger rows but alter none, so earlier choices stand.

The rate of epoch e is ``min(1, budget / records first seen up to e)``: later epochs are thinned
so the sample grows with the logarithm of the data once the budget is passed.

Defined cases
    * rows with a null identifier or epoch name no record and are left out;
    * a record delivered again keeps its first epoch; the payload kept is the least non-null one of
      that epoch, so that order and partitioning do not matter;
    * null payloads are kept as null; an empty table gives an empty ledger and sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import bounded, cut, shared_dir
from .philox import with_philox


def first_seen(records: DataFrame, id_col: str, epoch_col: str, payload: str | None = None) -> DataFrame:
    """One row per record: ``id_col, first_epoch`` and the payload of that epoch. Combines map-side."""
    rows = records.where(F.col(id_col).isNotNull() & F.col(epoch_col).isNotNull())
    if payload is None:
        return rows.groupBy(id_col).agg(F.min(epoch_col).alias("first_epoch"))
    # nulls sort first in a struct: rank them behind every value of the same epoch
    first = F.min(F.struct(F.col(epoch_col).alias("e"), F.col(payload).isNull().alias("n"), F.col(payload).alias("p")))
    return rows.groupBy(id_col).agg(first.alias("f")).select(id_col, F.col("f.e").alias("first_epoch"), F.col("f.p").alias(payload))


def epoch_rates(ledger: DataFrame, budget: int) -> DataFrame:
    """``first_epoch, rate``: one row per epoch."""
    sizes = ledger.groupBy("first_epoch").agg(F.count("*").alias("n"))
    seen = F.sum("n").over(Window.orderBy("first_epoch").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("first_epoch", F.least(F.lit(1.0), F.lit(float(budget)) / seen).alias("rate"))


def open_ledger(records: DataFrame, id_col: str, epoch_col: str, payload: str, budget: int) -> DataFrame:
    """The ledger of all epochs at hand: ``id_col, payload, first_epoch, rate``, written to the shared folder."""
    if budget < 1:
        raise ValueError("budget must be at least 1")
    seen = cut(first_seen(records, id_col, epoch_col, payload), "seen")
    return cut(seen.join(bounded(epoch_rates(seen, budget)), "first_epoch").select(id_col, payload, "first_epoch", "rate"), "ledger")


def extend_ledger(ledger: DataFrame, piece: DataFrame, id_col: str, epoch_col: str, payload: str, budget: int) -> DataFrame:
    """``ledger`` with the records of later epochs that it lacks. No row of it changes.

    Records that arrive late for an epoch already closed get that epoch's frozen rate.
    """
    new = first_seen(piece, id_col, epoch_col, payload).join(ledger.select(id_col), id_col, "left_anti")
    new = cut(new, "new")
    frozen = ledger.groupBy("first_epoch").agg(F.min("rate").alias("rate"))
    sizes = ledger.groupBy("first_epoch").agg(F.count("*").alias("n")).unionByName(
        new.join(bounded(frozen), "first_epoch", "left_anti").groupBy("first_epoch").agg(F.count("*").alias("n"))
    )
    seen = F.sum("n").over(Window.orderBy("first_epoch").rowsBetween(Window.unboundedPreceding, 0))
    rates = sizes.select("first_epoch", F.least(F.lit(1.0), F.lit(float(budget)) / seen).alias("fresh"))
    rates = rates.join(frozen, "first_epoch", "left").select("first_epoch", F.coalesce("rate", "fresh").alias("rate"))
    added = new.join(bounded(rates), "first_epoch").select(id_col, payload, "first_epoch", "rate")
    return cut(ledger.unionByName(added), "ledger")


class Ledger:
    """A ledger stored under a path. ``extend`` adds what records bring that is new; a row once written never changes.

    Every extension that adds records writes a version of its own; the last complete one counts, and
    no version is written twice, so a run that is lost half-way leaves the ledger as it was.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, epoch_col: str, payload: str, budget: int) -> None:
        if budget < 1:
            raise ValueError("budget must be at least 1")
        self.spark, self.path, self.columns, self.budget = spark, path.rstrip("/"), (id_col, epoch_col, payload), budget

    def _last(self) -> int:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        return max((int(f.getPath().getParent().getName()) for f in found or []), default=-1)

    @property
    def table(self) -> DataFrame | None:
        """The rows as last stored; None before the first extension."""
        last = self._last()
        return None if last < 0 else self.spark.read.parquet(f"{self.path}/{last}")

    def extend(self, records: DataFrame) -> "Ledger":
        old = self.table
        if old is None:
            new = open_ledger(records, *self.columns, self.budget)
        else:
            new = extend_ledger(old, records, *self.columns, self.budget)
            if new.count() == old.count():
                return self
        new.write.parquet(f"{self.path}/{self._last() + 1}")
        return self

    def sample(self, seed: int) -> DataFrame:
        """The selected records so far."""
        held = self.table
        if held is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return select_epoch_sample(held, self.columns[0], seed)


def kept_ledger(records: DataFrame, id_col: str, epoch_col: str, payload: str, budget: int, name: str) -> DataFrame:
    """The ledger called ``name`` in the shared folder, extended by what ``records`` has new."""
    spark = records.sparkSession
    return Ledger(spark, f"{shared_dir(spark)}/sparvec/ledgers/{name}-{budget}", id_col, epoch_col, payload, budget).extend(records).table


def select_epoch_sample(ledger: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The ledger's selected records, with their uniform ``u``."""
    return with_philox(ledger, id_col, seed).where(F.col("u") < F.col("rate"))
