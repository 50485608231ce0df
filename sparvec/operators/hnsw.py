"""Layered proximity graph: one graph per shard, built in one task, all shards searched and merged.

Insertion depends on order, so a shard's graph is built sequentially (by identifier) inside a task;
shards are bounded and build in parallel. The graph is a table ``(shard, id, level, vector, links)``;
a search task restores its shard from the rows. ``num_shards=1`` gives one graph over all rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_vectors, hash_order, hash_uniform, normalize
from ..plans.storage import cut
from .blocks import empty_result, matrix, query_blocks
from .exact import unit_queries


@dataclass(frozen=True)
class HNSWConfig:
    dims: int
    m: int = 16
    ef_construction: int = 200
    seed: int = 42
    shard_rows: int = 20_000
    num_shards: int | None = None

    def __post_init__(self) -> None:
        if self.dims < 1 or self.m < 2 or self.ef_construction < 1:
            raise ValueError("dims and ef_construction must be positive and m at least 2")


class LayeredGraph:
    """One shard's graph. Rows are unit float32; distances are 1 - dot."""

    def __init__(self, dims: int, m: int, ef_construction: int) -> None:
        self.m, self.ef = m, ef_construction
        self.x = np.zeros((0, dims), np.float32)
        self.n = 0
        self.links: list[list[list[int]]] = []
        self.entry, self.top = -1, -1

    def room(self, level: int) -> int:
        return 2 * self.m if level == 0 else self.m

    def _dist(self, q: np.ndarray, rows: list[int]) -> list[float]:
        return (1.0 - self.x[rows] @ q).tolist()

    def beam(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> tuple[list[tuple[float, int]], int]:
        """The ``ef`` nearest reached on a level, nearest first, and the distances computed."""
        seen = {i for _, i in starts}
        todo = list(starts)
        heapq.heapify(todo)
        kept = [(-d, -i) for d, i in starts]
        heapq.heapify(kept)
        while len(kept) > ef:
            heapq.heappop(kept)
        work = 0
        while todo:
            d, i = heapq.heappop(todo)
            if d > -kept[0][0]:
                break
            fresh = [j for j in self.links[i][level] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            work += len(fresh)
            for e, j in zip(self._dist(q, fresh), fresh):
                if len(kept) < ef:
                    heapq.heappush(kept, (-e, -j))
                elif e < -kept[0][0]:
                    heapq.heapreplace(kept, (-e, -j))
                else:
                    continue
                heapq.heappush(todo, (e, j))
        return sorted((-d, -i) for d, i in kept), work

    def diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates nearest first, those not strictly closer to one already chosen than to the base."""
        chosen: list[int] = []
        for d, i in near:
            if len(chosen) == most:
                break
            if not chosen or not (1.0 - self.x[chosen] @ self.x[i] < d).any():
                chosen.append(i)
        return chosen

    def add(self, v: np.ndarray, level: int) -> None:
        i = self.n
        if i == len(self.x):
            self.x = np.concatenate([self.x, np.zeros((max(64, len(self.x)), len(v)), np.float32)])
        self.x[i] = v
        self.n += 1
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        at = [(self._dist(v, [self.entry])[0], self.entry)]
        for lv in range(self.top, level, -1):
            at = self.beam(v, at, 1, lv)[0]
        for lv in range(min(level, self.top), -1, -1):
            at = self.beam(v, at, self.ef, lv)[0]
            mine = self.diverse(at, self.m)
            self.links[i][lv] = mine
            for j in mine:
                other = self.links[j][lv]
                other.append(i)
                if len(other) > self.room(lv):
                    near = sorted(zip(self._dist(self.x[j], other), other))
                    self.links[j][lv] = self.diverse(near, self.room(lv))
        if level > self.top:
            self.entry, self.top = i, level

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[list[tuple[float, int]], int]:
        """(distance, row) of the nearest ``k``, and the distances computed."""
        if self.n == 0 or k == 0:
            return [], 0
        at, work = [(self._dist(q, [self.entry])[0], self.entry)], 1
        for lv in range(self.top, 0, -1):
            at, w = self.beam(q, at, 1, lv)
            work += w
        at, w = self.beam(q, at, ef, 0)
        return at[:k], work + w

    def unreachable(self) -> int:
        if self.n == 0:
            return 0
        seen, stack = {self.entry}, [self.entry]
        while stack:
            for j in self.links[stack.pop()][0]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        return self.n - len(seen)


GRAPH_SCHEMA = "shard int, id long, row int, level int, entry boolean, vector array<float>, links array<array<int>>"


class _StoredLinks:
    """A graph's links as stored: a node's lists are made when a walk first comes by."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        levels = column.combine_chunks()
        levels = levels.chunk(0) if isinstance(levels, pa.ChunkedArray) else levels
        self.nodes, inner = levels.offsets.to_numpy(), levels.values
        self.levels, self.to = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
        self.made: dict[int, list[list[int]]] = {}

    def __getitem__(self, i: int) -> list[list[int]]:
        if i not in self.made:
            self.made[i] = [self.to[self.levels[j] : self.levels[j + 1]].tolist() for j in range(self.nodes[i], self.nodes[i + 1])]
        return self.made[i]


def _restore(table: pa.Table, dims: int, m: int, ef: int = 1) -> tuple[LayeredGraph, np.ndarray]:
    """The graph of a shard's rows; with ``ef`` one that can grow."""
    table = table.sort_by("row")
    g = LayeredGraph(dims, m, ef)
    g.x = matrix(table.column("vector"))
    g.n = table.num_rows
    g.links = _StoredLinks(table.column("links")) if ef == 1 else table.column("links").to_pylist()
    entry = np.nonzero(table.column("entry").to_numpy(zero_copy_only=False))[0]
    g.entry = int(entry[0])
    g.top = len(g.links[g.entry]) - 1
    return g, table.column("id").to_numpy()


def _shard_search(sent, dims: int, m: int, k: int, ef: int):
    def search_shard(table: pa.Table) -> pa.Table:
        g, ids = _restore(table, dims, m)
        rows = []
        for qid, v in zip(sent.value[0].tolist(), sent.value[1]):
            near, work = g.search(v, k, ef)
            x = g.x[[i for _, i in near]].astype(np.float64) @ v.astype(np.float64)
            rows += [(qid, int(ids[i]), float(s), work) for (_, i), s in zip(near, x)]
        cols = list(zip(*rows)) if rows else [[]] * 4
        part = pa.array([table.column("part")[0].as_py()] * len(cols[0]), pa.int32())
        return pa.table({"part": part, "query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64()), "work": pa.array(cols[3], pa.int64())})

    return search_shard


def _placed(vectors: DataFrame, cfg: HNSWConfig, shards: int) -> DataFrame:
    """``(id, vector, level, shard)``; level and shard depend on the identifier alone."""
    ident = F.col("id").cast("long")
    # floor(-ln(1 - u) / ln M), u from the identifier's hash: the same in any order
    level = F.floor(-F.log(F.lit(1.0) - hash_uniform(cfg.seed, ident)) / F.lit(math.log(cfg.m))).cast("int")
    shard = F.pmod(F.conv(F.substring(hash_order(cfg.seed, F.lit("shard"), ident), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return vectors.select(ident.alias("id"), normalize(F.col("vector")).alias("vector"), level.alias("level"), shard.alias("shard"))


def _grown(old: pa.Table | None, new: pa.Table, cfg: HNSWConfig) -> pa.Table:
    """A shard's graph with the new rows inserted in order of identifier."""
    columns = ["shard", "id", "level", "vector"]
    new = new.sort_by("id").select(columns)
    if old is None or not old.num_rows:
        g, rows = LayeredGraph(cfg.dims, cfg.m, cfg.ef_construction), new
    else:
        g, _ = _restore(old, cfg.dims, cfg.m, max(2, cfg.ef_construction))
        g.ef = cfg.ef_construction
        rows = pa.concat_tables([old.sort_by("row").select(columns).cast(new.schema), new])
    for v, level in zip(matrix(new.column("vector")), new.column("level").to_pylist()):
        g.add(v, level)
    at = range(rows.num_rows)
    return pa.table(
        {
            "shard": rows.column("shard"), "id": rows.column("id"), "row": pa.array(at, pa.int32()), "level": rows.column("level"),
            "entry": pa.array([i == g.entry for i in at]), "vector": rows.column("vector"), "links": pa.array(g.links, pa.list_(pa.list_(pa.int32()))),
        }
    )


@dataclass
class HNSWIndex:
    """Immutable: ``add`` gives the index that holds the new rows too, a rejected call leaves nothing behind."""

    cfg: HNSWConfig
    graph: DataFrame
    size: int
    shards: int = 1

    @classmethod
    def build(cls, vectors: DataFrame, cfg: HNSWConfig) -> "HNSWIndex":
        n = check_vectors(vectors, "vector", cfg.dims)
        shards = cfg.num_shards or max(1, math.ceil(n / cfg.shard_rows))
        rows = _placed(vectors, cfg, shards)
        return cls(cfg, cut(rows.groupBy("shard").applyInArrow(lambda new: _grown(None, new, cfg), GRAPH_SCHEMA), "hnsw"), n, shards)

    def add(self, vectors: DataFrame) -> "HNSWIndex":
        """The index with further ``(id, vector)`` rows, inserted into the graphs as they stand, in order of identifier."""
        cfg, n = self.cfg, check_vectors(vectors, "vector", self.cfg.dims)
        held, new = self.graph.groupBy("shard"), _placed(vectors, cfg, self.shards).groupBy("shard")
        return HNSWIndex(cfg, cut(held.cogroup(new).applyInArrow(lambda old, new: _grown(old, new, cfg), GRAPH_SCHEMA), "hnsw"), self.size + n, self.shards)

    def search(self, queries: DataFrame, k: int, ef_search: int = 50) -> DataFrame:
        """``(query_id, rank, id, score, distance_computations)``: the work is summed over the shards."""
        if ef_search < k:
            raise ValueError("ef_search must be at least k")
        q = unit_queries(queries, self.cfg.dims)
        schema = "part int, query_id long, id long, score double, work long"
        if k == 0 or self.size == 0:
            return empty_result(queries).withColumn("distance_computations", F.lit(0).cast("long"))
        dims, m, out = self.cfg.dims, self.cfg.m, None
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
        blocks = query_blocks(q, "query_id")
        block = next(blocks)
        while block is not None:  # one block of queries is on the driver at a time
            sent = queries.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), matrix(block.column("vector"))))
            found = self.graph.withColumnRenamed("shard", "part").groupBy("part").applyInArrow(_shard_search(sent, dims, m, k, ef_search), schema)
            top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            top = top.join(self._work(found), "query_id").select("query_id", "rank", "id", "score", "distance_computations")
            block = next(blocks, None)
            if block is None and out is None:
                return top
            top = cut(top, "block")
            sent.destroy()
            out = top if out is None else out.unionByName(top)
        return out

    @staticmethod
    def _work(found: DataFrame) -> DataFrame:
        each = found.groupBy("query_id", "part").agg(F.first("work").alias("work"))  # a shard repeats its count on each of its rows
        return each.groupBy("query_id").agg(F.sum("work").alias("distance_computations"))

    def edges(self) -> DataFrame:
        """``(shard, level, src, dst)`` in row numbers of the shard."""
        e = self.graph.select("shard", F.col("row").alias("src"), F.posexplode("links").alias("level", "to"))
        return e.select("shard", "level", "src", F.explode("to").alias("dst"))

    def stats(self) -> DataFrame:
        """One row: size, top level, links, payload bytes and rows that layer 0 does not reach."""
        g = self.graph
        links = F.aggregate(F.transform("links", F.size), F.lit(0), lambda a, b: a + b)
        base = g.agg(
            F.count("*").alias("size"), F.coalesce(F.max("level"), F.lit(0)).alias("top_level"), F.coalesce(F.sum(links), F.lit(0)).alias("links"),
            (F.count("*") * (4 * self.cfg.dims) + F.coalesce(F.sum(links), F.lit(0)) * 4).alias("payload_bytes"),
        )
        dims, m = self.cfg.dims, self.cfg.m

        def lost(table: pa.Table) -> pa.Table:
            return pa.table({"lost": pa.array([_restore(table, dims, m)[0].unreachable()], pa.int64())})

        gone = g.withColumnRenamed("shard", "part").groupBy("part").applyInArrow(lost, "lost long").agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("unreachable"))
        return base.crossJoin(F.broadcast(gone))


def count_unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame, cut_every: int = 5) -> int:
    """Nodes that directed ``edges`` (src, dst) do not reach from ``entries`` (id): frontier joins until no growth."""
    total = nodes.select("id").distinct().count()
    reached = cut(entries.select("id").distinct(), "reached")
    frontier, n = reached, reached.count()
    while True:
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(reached, "id", "left_anti"), "frontier")
        more = frontier.count()
        if more == 0:
            return total - n
        n += more
        reached = reached.unionByName(frontier)
