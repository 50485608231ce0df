"""The most similar vectors of every vector.

Records are routed to cells (see ``units``), whose number grows with the rows; a record is indexed
in its home cell, a shard, and asks at most ``probes`` cells whatever their number, home among them.
Each shard builds one robust-pruned directed graph (see ``graph``) over the records indexed there
and answers by beam search; the shards' answers are merged. With a positive ``least_cos`` a record
asks only cells whose bisector is within reach of pairs so close, so most ask their own alone.

Exact copies (equal unit vectors under several identifiers) are collapsed first, before and after
the shuffle, so a vector that fills a third of the table is one record in one shard. Copies keep
their ``k + 1`` smallest identifiers, which by the tie rule are all that can be in an answer;
further copies get the answer those give.

Defined cases
    * unusable vectors and null identifiers are left out; a record delivered again counts once;
    * equal scores go to the lower identifier; a record is not its own neighbour;
    * fewer than k other records give all that the probed shards hold; an empty table gives no rows;
    * other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut
from .graph import Graph
from .units import Cells, distinct_units, fit_cells, packed, unpacked, usable_units

SHARD_ROWS = 16_384
PROBES = 3
DEGREE = 20
BEAM = 32
BROADCAST_ROWS = 200_000
#: Tasks of the search stage at most; beyond it a task takes several shards, one after the other.
MOST_PARTITIONS = 20_000


def _row_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes."""
    words = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    h = np.full(len(x), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _runs(x: np.ndarray, ids: np.ndarray, owner: np.ndarray, more: np.ndarray, keep: int) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """Runs of equal rows of ``x`` (of which ``ids[i]`` belongs to row ``owner[i]``): first row, the ``keep`` smallest ids, whether there are more."""
    new = np.append(True, (x[1:].view(np.uint32) != x[:-1].view(np.uint32)).any(axis=1))
    first = np.nonzero(new)[0]
    run = (np.cumsum(new) - 1)[owner]
    order = np.lexsort((ids, run))
    run, ids = run[order], ids[order]
    once = np.append(True, (run[1:] != run[:-1]) | (ids[1:] != ids[:-1]))
    run, ids = run[once], ids[once]
    size = np.bincount(run, minlength=len(first))
    place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    held = np.minimum(size, keep)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), pa.array(ids[place < keep]))
    return first, lists, np.logical_or.reduceat(more, first) | (size > keep)


def collapsed_copies(units: DataFrame, keep: int, dims: int) -> DataFrame:
    """One row per distinct unit vector: ``(u, ids, more)`` with its ``keep`` smallest identifiers.

    Copies are joined within each batch before the shuffle, so a vector that fills much of the table
    is a few rows of it, and behind it in order of their bytes, of which one run is held at a time.
    """
    schema = "h long, u binary, ids array<long>, more boolean"
    names = ["h", "u", "ids", "more"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x = b.column(0).to_numpy(zero_copy_only=False), unpacked(b.column(1), dims)
                h = _row_hashes(x)
                order = np.argsort(h, kind="stable")
                x = x[order]
                first, lists, more = _runs(x, ids[order], np.arange(len(x)), np.zeros(len(x), bool), keep)
                yield pa.RecordBatch.from_arrays([pa.array(h[order][first]), packed(x[first]), lists, pa.array(more)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the run that may go on
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            x = unpacked(b.column(1), dims)
            lists = b.column(2)
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            first, ids, more = _runs(x, lists.flatten().to_numpy(), owner, b.column(3).to_numpy(zero_copy_only=False), keep)
            out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), packed(x[first]), ids, pa.array(more)], names=names)
            held = pa.RecordBatch.from_arrays([c.take(pa.array([len(first) - 1])) for c in out.columns], names=names)
            if len(first) > 1:
                yield out.slice(0, len(first) - 1)
        if held is not None:
            yield held

    joined = units.mapInArrow(partial, schema).repartition("h").sortWithinPartitions("h", "u")
    return joined.mapInArrow(whole, schema).select("u", "ids", "more")


def pair_reach(least_cos: float, dims: int) -> float:
    """How far from a bisector a record still asks the cell beyond it.

    Of two vectors of cosine c the one is c times the other and a part of length sqrt(1 - c^2) in a
    direction that knows nothing of the cells; along any bisector that part is spread by
    sqrt((1 - c^2) / dims). Of two vectors on different sides the nearer one lies within half their
    difference, and both may ask, so 1.2 times the spread misses few (the README has measured shares).
    """
    return 1.2 * math.sqrt((1 - min(1.0, least_cos) ** 2) / dims) if least_cos > 0 else math.inf


def _routed(reps: DataFrame, cells: Cells, probes: int, dims: int, reach: float) -> DataFrame:
    """``(shard, home, id, u)``: each record in its own cell (home) and in the cells it asks, ``probes`` in all."""
    sent = reps.sparkSession.sparkContext.broadcast(cells)  # at most MOST_CELLS centroids

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = sent.value.near(unpacked(b.column(1), dims), probes, reach).astype(np.int32)
            for j in range(near.shape[1]):
                rows = np.nonzero(near[:, j] >= 0)[0]
                if len(rows):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(near[rows, j]), pa.array(np.full(len(rows), j == 0)), b.column(0).take(take), b.column(1).take(take)], names=["shard", "home", "id", "u"])

    return reps.mapInArrow(route, "shard int, home boolean, id long, u binary")


class _Hits:
    """Scored pairs of a shard's records."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, least_cos: float) -> None:
        self.ids, self.x, self.least_cos, self.rows = ids, x, least_cos, []

    def add(self, q: np.ndarray, r: np.ndarray) -> None:
        for a in range(0, len(q), 65_536):
            qa, ra = q[a : a + 65_536], r[a : a + 65_536]
            s = np.einsum("ij,ij->i", self.x[qa], self.x[ra], dtype=np.float64)
            near = s >= self.least_cos
            self.rows.append((self.ids[qa[near]], self.ids[ra[near]], np.minimum(1.0, s[near])))

    def table(self) -> pa.Table:
        q, r, s = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else ([], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "r": pa.array(r, pa.int64()), "score": pa.array(s, pa.float64())})


def _walked(graph: Graph, x: np.ndarray, rows: np.ndarray, own: bool, k: int, beam: int, hits: _Hits, both: bool) -> None:
    """Adds what beam search finds for ``rows`` of ``x``; ``own``: they are nodes of the graph."""
    for a in range(0, len(rows), graph.block):
        part = rows[a : a + graph.block]
        found, _ = graph.search(x[part], max(beam, k + 1), start=part if own else None)
        found = found[:, : k + 1]
        i, j = np.nonzero((found >= 0) & ((found != part[:, None]) if own else True))
        q, r = part[i], found[i, j]
        hits.add(q, r)
        if both:
            hits.add(r, q)


def _shard_search(dims: int, k: int, least_cos: float, degree: int, beam: int):
    """Searches one shard: its own records, and those of other cells that ask it.

    For close pairs (positive ``least_cos``) the walks that insert a record already find its neighbours
    among the records before it, and later ones find it; a found pair counts for both its records. Only
    a record with ``k`` or more hits so far, whose list may be cut short, walks again in the whole graph.
    """
    close = least_cos > 0

    def search(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        ids = table.column("id").to_numpy()
        order = np.lexsort((ids, ~home))  # the shard's own records first, by identifier
        ids, x, n = ids[order], unpacked(table.column("u"), dims)[order], int(home.sum())
        hits = _Hits(ids, x, least_cos)
        if n == 0:
            return hits.table()
        graph = Graph(x[:n], degree=degree, beam=beam, least=least_cos if close else None)
        again = np.arange(n)
        if close:
            a, b = graph.met()
            hits.add(a, b)
            hits.add(b, a)
            again = np.nonzero(np.bincount(np.concatenate([a, b]), minlength=n) >= k)[0]
        _walked(graph, x, again, True, k, beam, hits, close)
        _walked(graph, x, np.arange(n, len(x)), False, k, beam, hits, close)
        return hits.table()

    return search


def most_similar(
    vectors: DataFrame,
    k: int,
    *,
    least_cos: float = -1.0,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    dims: int = 50,
    shard_rows: int = SHARD_ROWS,
    probes: int = PROBES,
    degree: int = DEGREE,
    beam: int = BEAM,
    seed: int = 42,
) -> DataFrame:
    """``(query_id, rank, id, score)``: up to ``k`` neighbours of every record with a cosine of ``least_cos`` or more."""
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be at least 1")
    units = usable_units(vectors, id_col, vector_col, dims)
    held = cut(collapsed_copies(units, k + 1, dims), "records")
    rows = held.count()
    reps = held.select(F.col("ids")[0].alias("id"), "u")
    cells = fit_cells(reps, dims, rows, shard_rows, seed=seed)
    asked = _routed(reps, cells, probes, dims, pair_reach(least_cos, dims))
    asked = asked.repartitionById(min(cells.total, MOST_PARTITIONS), F.col("shard"))  # a shard to a task
    found = asked.groupBy("shard").applyInArrow(_shard_search(dims, k, least_cos, degree, beam), "q long, r long, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("r").asc())
    if least_cos > 0:  # both sides may have found a pair
        found = found.groupBy("q", "r").agg(F.max("score").alias("score"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    several = held.where(F.size("ids") > 1).select(F.col("ids")[0].alias("rep"), "ids")
    copies = several.limit(BROADCAST_ROWS + 1).count()
    if copies:
        side = F.broadcast(several) if copies <= BROADCAST_ROWS else several
        q_side = side.select(F.col("rep").alias("q"), F.col("ids").alias("q_ids"))
        r_side = side.select(F.col("rep").alias("r"), F.col("ids").alias("r_ids"))
        spread_out = top.select("q", "r", "score").join(q_side, "q", "left").join(r_side, "r", "left")
        spread_out = spread_out.select(F.explode(F.coalesce("q_ids", F.array("q"))).alias("q"), F.coalesce("r_ids", F.array("r")).alias("r_ids"), "score")
        spread_out = spread_out.select("q", F.explode("r_ids").alias("r"), "score")
        among = several.select(F.explode("ids").alias("q"), "ids").select("q", F.explode("ids").alias("r"), F.lit(1.0).alias("score")).where("q <> r")
        if held.where("more").limit(1).count():
            crowd = held.where("more").select("u", "ids")
            later = units.join(crowd, "u").where(~F.array_contains("ids", F.col("id"))).select(F.col("id").alias("q"), "ids").dropDuplicates(["q"])
            among = among.unionByName(later.select("q", F.explode("ids").alias("r"), F.lit(1.0).alias("score")))
        every = spread_out.unionByName(among)
        top = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select(F.col("q").alias("query_id"), "rank", F.col("r").alias("id"), "score")


def distinct_records(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "vector", dims: int = 50) -> DataFrame:
    """``(id, u)``: each usable record once."""
    return cut(distinct_units(usable_units(vectors, id_col, vector_col, dims)), "distinct")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs ``(vec_id_a, vec_id_b)``, a < b, each once."""
    return neighbours.select(F.least("query_id", "id").alias("vec_id_a"), F.greatest("query_id", "id").alias("vec_id_b")).distinct()


def exact_neighbours(units: DataFrame, queries: DataFrame, k: int, dims: int, block: int = 4_096) -> DataFrame:
    """``(query_id, id, score)``: the exact ``k`` nearest of a stated query set, against all rows, in blocks of queries.

    ``units`` and ``queries`` are ``(id, u)``; a block is read to the driver and broadcast (at most about ``block`` rows).
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    for j in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == j).orderBy("id").toArrow()
        sent = units.sparkSession.sparkContext.broadcast((part.column("id").to_numpy(), unpacked(part.column("u"), dims).copy()))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            for b in batches:
                if not b.num_rows or not len(qid):
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                s = q @ unpacked(b.column(1), dims).T
                s[qid[:, None] == ids[None, :]] = -2.0
                m = min(k, s.shape[1])
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                val = np.take_along_axis(s, at, axis=1).astype(np.float64)
                keep = val > -1.5
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[at[r, c]]), pa.array(val[r, c])], names=["query_id", "id", "score"])

        found = units.select("id", "u").mapInArrow(scan, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return out.dropDuplicates(["query_id", "id"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
