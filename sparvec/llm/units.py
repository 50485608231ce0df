"""Usable vectors as unit vectors, and their routing to cells.

A vector is usable if it holds exactly ``dims`` finite numbers that are not all zero. Unit vectors
travel as little-endian float32 bytes: the JVM moves them unopened and numpy reads them in place.
Cells are the Voronoi regions of centroids in two levels, fitted on bounded samples by identifier
hash (the same on every run and partitioning); their number grows with the rows, so a cell stays
bounded and routing costs about the square root of their number. Every row is routed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows the regions are fitted on: a documented bound, whatever the size of the data.
SAMPLE_ROWS = 16_384
#: Rows that a region's cells are fitted on, for each of them and in all.
CELL_SAMPLE, REGION_SAMPLE = 64, 65_536
#: Cells that are fitted in one level, and cells at most (26 MB of centroids of 50 numbers to send).
ONE_LEVEL, MOST_CELLS = 64, 131_072


def unit_block(ids: pa.Array, vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and unit vectors of a batch's usable rows."""
    if pa.types.is_large_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    ends = vectors.offsets.to_numpy()
    length = ends[1:] - ends[:-1]
    there = (length == dims) & vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    rows = np.nonzero(there)[0]
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(rows) == 0:
        return np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
    x = values[ends[rows][:, None] + np.arange(dims)]
    with np.errstate(invalid="ignore", over="ignore"):
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)  # a null number arrives as NaN
    rows, x = rows[ok], x[ok]
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64), x.astype(np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as binary values."""
    x = np.ascontiguousarray(x, dtype="<f4")
    n, width = x.shape[0], x.shape[1] * 4 if x.ndim == 2 else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    n = len(column)
    if n == 0:
        return np.zeros((0, dims), np.float32)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    start = np.frombuffer(column.buffers()[1], kind)[column.offset]
    return np.frombuffer(column.buffers()[2], "<f4", n * dims, int(start)).reshape(n, dims)


def usable_units(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """``(id long, u binary)`` of every usable row, records delivered again among them."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = unit_block(b.column(0), b.column(1), dims)
            yield pa.RecordBatch.from_arrays([pa.array(ids), packed(x)], names=["id", "u"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(units, "id long, u binary")


def distinct_units(units: DataFrame) -> DataFrame:
    """One row per identifier: sorted within partitions by identifier, so equal ones follow each other and nothing is held."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                new = np.append(ids[0] != last if last is not None else True, ids[1:] != ids[:-1])
                last = int(ids[-1])
                yield b if new.all() else b.filter(pa.array(new))

    return units.repartition("id").sortWithinPartitions("id").mapInArrow(once, "id long, u binary")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.empty(len(x), np.int64)
        for s in range(0, len(x), 4096):
            at[s : s + 4096] = (x[s : s + 4096] @ c.T).argmax(axis=1)
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], c).astype(np.float32)
    return c


@dataclass
class Cells:
    """Routing centroids in two levels: region ``i`` of ``top`` holds the cells ``first[i]`` to ``first[i + 1]`` of ``centroids``.

    A record's home is the nearest cell of its nearest region. How far it is from any other cell is
    its distance to the bisector between the two, at the level where they part.
    """

    top: np.ndarray
    centroids: np.ndarray
    first: np.ndarray

    @property
    def total(self) -> int:
        return len(self.centroids)

    def near(self, x: np.ndarray, n: int, reach: float = math.inf) -> np.ndarray:
        """Of each row its home and at most ``n - 1`` further cells, nearest bisector first and none beyond ``reach``; -1 pads."""
        m, n = len(x), min(n, self.total)
        regions, apart = _bisectors(x, self.top, n, reach)
        cell = np.full((m, regions.shape[1] * n), -1, np.int64)
        away = np.full(cell.shape, np.inf, np.float32)
        for j in range(regions.shape[1]):
            order = np.argsort(regions[:, j], kind="stable")
            held = regions[order, j]
            for part in np.split(order, np.nonzero(np.diff(held))[0] + 1):
                t = regions[part[0], j] if len(part) else -1
                if t < 0:
                    continue
                a, b = self.first[t], self.first[t + 1]
                if b - a == 1:
                    cell[part, j * n], away[part, j * n] = a, apart[part, j]
                    continue
                inside, gap = _bisectors(x[part], self.centroids[a:b], n, reach)
                w = inside.shape[1]
                cell[part, j * n : j * n + w] = np.where(inside >= 0, inside + a, -1)
                away[part, j * n : j * n + w] = np.maximum(gap, apart[part, j][:, None])
        order = np.argsort(away, axis=1, kind="stable")[:, :n]
        return np.where(np.take_along_axis(away, order, axis=1) <= reach, np.take_along_axis(cell, order, axis=1), -1)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.near(x, 1)[:, 0]


def _bisectors(x: np.ndarray, c: np.ndarray, n: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``c`` and at most ``n - 1`` others by distance to the bisector with it, with these distances; -1 beyond ``reach``."""
    s = x @ c.T
    rows = np.arange(len(x))
    own = s.argmax(axis=1)
    if n == 1 or len(c) == 1:
        return own[:, None], np.zeros((len(x), 1), np.float32)
    apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * (c @ c.T), 1e-12))
    gap = (s[rows, own][:, None] - s) / apart[own]
    gap[rows, own] = -1.0  # comes first
    n = min(n, len(c))
    at = np.argpartition(gap, n - 1, axis=1)[:, :n]
    at = np.take_along_axis(at, np.argsort(np.take_along_axis(gap, at, axis=1), axis=1, kind="stable"), axis=1)
    gap = np.maximum(np.take_along_axis(gap, at, axis=1), 0.0)
    return np.where(gap <= reach, at, -1), np.where(gap <= reach, gap, np.inf).astype(np.float32)


def spread(ids: np.ndarray) -> np.ndarray:
    """A 64-bit mix of identifiers (splitmix64's finalizer), for sharding."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _sample(units: DataFrame, dims: int, rows: int, wanted: int) -> np.ndarray:
    """The ``wanted`` distinct records of least identifier hash, of about ``rows``.

    Low hashes alone leave the scan (half as many again as wanted), so no task gathers more with more partitions.
    """
    share = min(1.0, 1.5 * wanted / max(1, rows))
    place = F.shiftrightunsigned(F.xxhash64("id"), 11)  # 53 bits
    some = units.where(place < int(share * 2**53)) if share < 1.0 else units
    some = some.select("id", "u", place.alias("place")).toArrow()
    ids, at = np.unique(some.column("id").to_numpy(), return_index=True)
    first = np.argsort(some.column("place").to_numpy()[at], kind="stable")[:wanted]
    return unpacked(some.column("u"), dims)[at[np.sort(first)]]


def fit_cells(units: DataFrame, dims: int, rows: int, cell_rows: int, *, rounds: int = 6, seed: int = 42) -> Cells:
    """Cells of about ``cell_rows`` rows each for ``rows`` rows; their number grows with the rows up to ``MOST_CELLS``, from there their size.

    Up to ``ONE_LEVEL`` cells are fitted on ``SAMPLE_ROWS`` records. Beyond that about the square root of
    their number are fitted as regions, and every region's cells by a task of its own on
    ``CELL_SAMPLE`` records a cell (``REGION_SAMPLE`` at most).
    """
    if rows == 0:
        return Cells(np.zeros((1, dims), np.float32), np.zeros((1, dims), np.float32), np.arange(2))
    k = min(MOST_CELLS, max(1, math.ceil(rows / cell_rows)))
    x = _sample(units, dims, rows, SAMPLE_ROWS)
    regions = k if k <= ONE_LEVEL else math.ceil(math.sqrt(k))
    top = spherical_kmeans(x, min(regions, max(1, len(x) // 8)), rounds, seed)
    if k <= ONE_LEVEL:
        return Cells(top, top, np.arange(len(top) + 1))
    sent = units.sparkSession.sparkContext.broadcast(top)  # at most the square root of MOST_CELLS rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount((unpacked(b.column(1), dims) @ sent.value.T).argmax(axis=1), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["region", "n"])

    sizes = units.select("id", "u").mapInArrow(count, "region int, n long").groupBy("region").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(len(top), np.int64)
    held[sizes.column("region").to_numpy()] = sizes.column("n").to_numpy()
    cells = np.maximum(1, np.round(held * (k / rows))).astype(np.int64)
    share = np.minimum(1.0, np.minimum(CELL_SAMPLE * cells, REGION_SAMPLE) / np.maximum(held, 1))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, at = b.column(0).to_numpy(zero_copy_only=False), (unpacked(b.column(1), dims) @ sent.value.T).argmax(axis=1)
                take = pa.array(np.nonzero(spread(ids).astype(np.float64) / 2.0**64 <= share[at])[0])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)).take(take), b.column(0).take(take), b.column(1).take(take)], names=["region", "id", "u"])

    def fit(table: pa.Table) -> pa.Table:
        region = table.column("region")[0].as_py()
        _, at = np.unique(table.column("id").to_numpy(), return_index=True)
        v = unpacked(table.column("u"), dims)[at]
        c = spherical_kmeans(v, int(min(cells[region], max(1, len(v) // 8))), rounds, seed)
        return pa.table({"region": pa.array([region] * len(c), pa.int32()), "n": pa.array(range(len(c)), pa.int32()), "u": packed(c)})

    fitted = units.select("id", "u").mapInArrow(some, "region int, id long, u binary").groupBy("region").applyInArrow(fit, "region int, n int, u binary")
    found = fitted.orderBy("region", "n").toArrow()  # at most about MOST_CELLS centroids
    region, c = found.column("region").to_numpy(), unpacked(found.column("u"), dims)
    known = np.unique(region)  # a region without records has no cell
    return Cells(top[known], c, np.searchsorted(region, np.append(known, len(top))))
