"""A subset of given size that covers the variety of the data.

Greedy maximisation of a facility-location objective, F(S) = sum over v of w(v) max over s in S of
sim(v, s), which is monotone and submodular, in two rounds. Round one: the records are hashed into
partitions of bounded size, and each nominates candidates by lazy greedy selection over its own
records. Round two: a lazy greedy pass over the nominated candidates selects the subset; a candidate
brings the demand of all the records it stands for, those that it is the closest candidate of. Where
the candidates are too many for one task they nominate again among themselves, so no task is
unbounded; a subset too large for one task is selected by several, each from a hashed share.

The similarity is the cosine, cut off at ``saturation``: a record that has a representative this
close counts as covered. A record's demand w(v) is one over the similarity mass around it (its own
included, cosines above ``background`` only), so the demands of a group of similar records add up
to about that of a few isolated ones however many they are, and sparse regions get their share.

Defined cases
    * unusable vectors (see ``units``) and null identifiers are left out; a record delivered again counts once;
    * equal gains go to the lower identifier; fewer than k records give all of them;
    * an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut
from .units import packed, unpacked, usable_units

PARTITION_ROWS = 4_096
FINAL_ROWS = 6_144
LEAST_NOMINATED = 64


def lazy_greedy(x: np.ndarray, k: int, saturation: float, background: float = 0.3, weight: np.ndarray | None = None) -> tuple[list[int], list[float], np.ndarray]:
    """Positions in selection order, their gains, and the demand each stands for. ``x``: unit rows, ordered by identifier.

    ``weight``: the demand of each row; by default one over the similarity mass around it.
    A record's demand goes to the selected record closest to it.
    """
    n = len(x)
    if n == 0 or k <= 0:
        return [], [], np.zeros(0)
    s = x @ x.T
    if weight is None:
        mass = np.empty(n, np.float32)
        for a in range(0, n, 1024):
            mass[a : a + 1024] = np.maximum(s[a : a + 1024] - background, 0.0).sum(axis=1)
        weight = (1 - background) / np.maximum(mass, 1 - background)
    demand = weight.astype(np.float32)
    np.clip(s, 0.0, saturation, out=s)
    gains = (s @ demand).astype(np.float64)
    heap = [(-g, i) for i, g in enumerate(gains.tolist())]
    heapq.heapify(heap)
    covered = np.zeros(n, np.float32)
    fresh = [0] * n
    chosen: list[int] = []
    won: list[float] = []
    while heap and len(chosen) < k:
        g, i = heap[0]
        if fresh[i] == len(chosen):
            heapq.heappop(heap)
            chosen.append(i)
            won.append(-g)
            np.maximum(covered, s[i], out=covered)
            continue
        gain = float(np.maximum(s[i] - covered, 0.0) @ demand)
        fresh[i] = len(chosen)
        heapq.heapreplace(heap, (-gain, i))  # gains only fall: the old one was a bound
    owner = (x @ x[chosen].T).argmax(axis=1)
    return chosen, won, np.bincount(owner, weights=weight.astype(np.float64), minlength=len(chosen))


def objective(x: np.ndarray, chosen: np.ndarray, weight: np.ndarray, saturation: float = 0.5) -> float:
    """The share of the demand ``weight`` of ``x`` that the rows ``chosen`` cover."""
    best = np.concatenate([(x[a : a + 4096] @ chosen.T).max(axis=1) for a in range(0, len(x), 4096)])
    return float((np.clip(best, 0.0, saturation) @ weight) / (saturation * weight.sum()))


def _nominate(dims: int, k: int, saturation: float, weighted: bool):
    def nominate(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        x = unpacked(table.column("u"), dims)[first]
        at, gains, stood = lazy_greedy(x, k, saturation, weight=table.column("w").to_numpy()[first] if weighted else None)
        return pa.table({"id": pa.array(ids[at], pa.int64()), "u": packed(x[at]) if at else pa.array([], pa.binary()), "w": pa.array(stood, pa.float64()), "place": pa.array(range(1, len(at) + 1), pa.int32()), "gain": pa.array(gains, pa.float64())})

    return nominate


def varied_subset(
    vectors: DataFrame,
    k: int,
    *,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    dims: int = 50,
    saturation: float = 0.5,
    partition_rows: int = PARTITION_ROWS,
    final_rows: int = FINAL_ROWS,
) -> DataFrame:
    """``(id_col, place, gain)`` of the ``k`` selected records in the order of selection (of gain where parts select)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    schema = "id long, u binary, w double, place int, gain double"
    pool = usable_units(vectors, id_col, vector_col, dims).withColumn("w", F.lit(1.0))
    rows, weighted = vectors.count(), False
    # a subset too large for one task is selected part by part, each part a hashed share of the candidates
    shares = max(1, math.ceil(2 * k / final_rows))
    most = final_rows * shares if shares > 1 else final_rows
    while True:
        parts = max(1, math.ceil(rows / partition_rows))
        if rows <= most and (parts == 1 or shares > 1):
            break
        each = min(k, max(LEAST_NOMINATED, math.ceil(4 * k / parts)))
        if each >= partition_rows:
            break  # a part would nominate all it has
        part = F.pmod(F.xxhash64("id", F.lit(rows)), F.lit(parts))
        nominated = pool.select("id", "u", "w", part.alias("part")).groupBy("part").applyInArrow(_nominate(dims, each, saturation, weighted), schema)
        pool, weighted = cut(nominated.select("id", "u", "w"), "nominated"), True
        before, rows = rows, pool.count()
        if rows <= most or rows >= before:
            break
    if rows <= final_rows:
        shares = 1
    else:
        shares = max(shares, math.ceil(rows / final_rows))
    each = k if shares == 1 else math.ceil(1.1 * k / shares) + 8
    part = F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(shares))
    final = pool.select("id", "u", "w", part.alias("part")).groupBy("part").applyInArrow(_nominate(dims, each, saturation, weighted), schema)
    if shares > 1:
        best = cut(final.select("id", "gain"), "selected").orderBy(F.col("gain").desc(), "id").limit(k)
        final = best.withColumn("place", F.row_number().over(Window.orderBy(F.col("gain").desc(), "id")))  # k rows
    return final.select(F.col("id").alias(id_col), "place", "gain")
