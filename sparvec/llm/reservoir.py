"""A uniform sample of fixed size from data that arrives in pieces of unknown size.

Pieces are counted after they arrive; a record belongs to the first piece that delivered it. The
pieces, each cut into leaves of about ``leaf_rows`` records by a hash of the identifier, hang in a
binary tree whose upper part has at most ``NODES`` nodes, each a share of the pieces. The sample size is split down the tree: at every node the left part's share is a
hypergeometric draw, so every set of k records is equally likely. Each leaf then runs sequential
selection sampling (accept with quota left / records left) over its records in identifier order.

The driver splits over the nodes; a task splits its node over pieces and leaves. Only the
identifiers, the leaf counts (one small row per ``leaf_rows`` records) and the k chosen identifiers move; the payload is read once, by a semi-join on the chosen ones.

Defined cases
    * rows with a null identifier or piece name no record;
    * a record delivered again is one record; its payload is that of its first piece (of several
      there, the least by the remaining columns' order of ``payload``);
    * fewer than k records give all of them; k = 0 or an empty table gives none;
    * null or unusable payloads are sampled like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import bounded, cut
from .philox import philox_uniform

#: Nodes of the upper part of the tree: what the driver sees of the counts.
NODES = 4_096


def _log_ratio(total: int, part: int, draws: int, x: int) -> float:
    """log of C(part, x) C(total - part, draws - x) / C(total, draws), summed from small factors."""

    def log_choose(n: int, k: int) -> float:
        k = min(k, n - k)
        if k <= 0:
            return 0.0
        out = 0.0
        for s in range(0, k, 1_000_000):
            i = np.arange(s, min(k, s + 1_000_000), dtype=np.float64)
            out += float(np.log((n - i) / (k - i)).sum())
        return out

    return log_choose(part, x) + log_choose(total - part, draws - x) - log_choose(total, draws)


def hypergeometric(u: float, left: int, right: int, draws: int) -> int:
    """How many of ``draws`` fall on the left, by inversion of one uniform from the mode outwards."""
    total = left + right
    if not 0 <= draws <= total:
        raise ValueError("more draws than records")
    low, high = max(0, draws - right), min(draws, left)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (left + 1) // (total + 2)))
    p0 = float(np.exp(_log_ratio(total, left, draws, mode)))
    u -= p0
    if u < 0:
        return mode
    up, pu, down, pd = mode, p0, mode, p0
    while True:
        moved = False
        if up < high:
            pu *= (left - up) * (draws - up) / ((up + 1) * (right - draws + up + 1))
            up += 1
            moved = True
            u -= pu
            if u < 0:
                return up
        if down > low:
            pd *= down * (right - draws + down) / ((left - down + 1) * (draws - down + 1))
            down -= 1
            moved = True
            u -= pd
            if u < 0:
                return down
        if not moved:  # rounding left a sliver of probability
            return mode


def split_quota(counts: list[int], k: int, seed: int) -> list[int]:
    """``k`` split over the leaves of a balanced binary tree. A node's uniform depends on its range and seed only."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    out = [0] * len(counts)
    stack = [(0, len(counts), min(k, int(ends[-1])))] if counts else []
    while stack:
        a, b, q = stack.pop()
        if q == 0:
            continue
        if b - a == 1:
            out[a] = q
            continue
        m = (a + b) // 2
        u = float(philox_uniform(np.array([(a << 32) | b]), seed)[0])
        x = hypergeometric(u, int(ends[m] - ends[a]), int(ends[b] - ends[m]), q)
        stack += [(a, m, x), (m, b, q - x)]
    return out


def sequential_selection(ids: np.ndarray, quota: int, seed: int) -> np.ndarray:
    """Exactly ``quota`` of the sorted distinct ``ids``, every subset equally likely."""
    left, out = quota, []
    n = len(ids)
    for i, u in enumerate(philox_uniform(ids, seed).tolist()):
        if left == 0:
            break
        if u * (n - i) < left:
            out.append(i)
            left -= 1
    return ids[out]


def fixed_size_sample(
    records: DataFrame,
    id_col: str,
    piece_col: str,
    payload: list[str],
    k: int,
    *,
    seed: int = 42,
    leaf_rows: int = 65_536,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """``k`` records ``(id_col, *payload, piece_col)``; ``piece_col`` is the first piece of the record."""
    if k < 0:
        raise ValueError("k must not be negative")
    named = records.where(F.col(id_col).isNotNull() & F.col(piece_col).isNotNull())
    first = named.groupBy(F.col(id_col).alias("id")).agg(F.min(piece_col).alias("piece"))
    first = cut(first, "pieces")
    sizes = first.groupBy("piece").agg(F.ceil(F.count("*") / F.lit(leaf_rows)).cast("long").alias("leaves"))
    leafed = first.join(F.broadcast(sizes) if sizes.limit(broadcast_rows + 1).count() <= broadcast_rows else sizes, "piece").select(
        "id", "piece", F.pmod(F.xxhash64("id"), F.col("leaves")).alias("leaf")
    )
    kind = first.schema["piece"].dataType.simpleString()
    counts = leafed.groupBy("piece", "leaf").agg(F.count("*").alias("n"))
    counts = cut(counts.withColumn("node", F.pmod(F.xxhash64("piece"), F.lit(NODES)).cast("int")), "leaves")
    totals = counts.groupBy("node").agg(F.sum("n").alias("n")).orderBy("node").collect()  # at most NODES rows
    shares = {r["node"]: q for r, q in zip(totals, split_quota([r["n"] for r in totals], k, seed)) if q}

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece", "ascending"), ("leaf", "ascending")])
        node = table.column("node")[0].as_py()
        quota = split_quota(table.column("n").to_pylist(), shares.get(node, 0), seed + 2 + node)
        table = table.select(["piece", "leaf"]).append_column("quota", pa.array(quota, pa.int64()))
        return table.filter(pa.array([q > 0 for q in quota], pa.bool_()))

    quota = cut(counts.groupBy("node").applyInArrow(split, f"piece {kind}, leaf long, quota long"), "quotas")
    held = leafed.join(bounded(quota, broadcast_rows), ["piece", "leaf"])

    def select(table: pa.Table) -> pa.Table:
        ids = np.sort(table.column("id").to_numpy())
        q = table.column("quota")[0].as_py()
        return pa.table({"id": pa.array(sequential_selection(ids, q, seed + 1), pa.int64())})

    chosen = held.select(F.col("id").cast("long").alias("id"), "piece", "leaf", "quota").groupBy("piece", "leaf").applyInArrow(select, "id long")
    chosen = cut(chosen, "chosen")
    rows = named.select(F.col(id_col).alias("id"), F.col(piece_col).alias("piece"), F.struct(*payload).alias("load"))
    rows = rows.join(F.broadcast(chosen) if k <= broadcast_rows else chosen, "id", "left_semi")
    one = rows.groupBy("id").agg(F.min(F.struct("piece", "load")).alias("x"))
    return one.select(F.col("id").alias(id_col), *[F.col("x.load")[c].alias(c) for c in payload], F.col("x.piece").alias(piece_col))
