"""Product quantization: the codec, and a flat index that scores codes through lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import check_vectors, first_by_hash, hash_order, normalize
from ..plans.storage import cut
from .blocks import empty_result, lists, matrix, query_blocks, scan
from .exact import unit_queries


#: Queries at a time where each brings a table of m x k numbers.
TABLE_BLOCK = 512


@dataclass(frozen=True)
class PQConfig:
    """``m`` sub-vectors, ``k`` sub-centroids each (at most 256, so a code is a byte)."""

    dims: int
    m: int
    k: int = 256
    max_iterations: int = 50
    tolerance: float = 1e-4
    seed: int = 42

    def __post_init__(self) -> None:
        if self.dims < 1 or self.m < 1 or self.dims % self.m:
            raise ValueError("dims must be a multiple of m")
        if not 1 <= self.k <= 256:
            raise ValueError("k must lie between 1 and 256")
        if self.max_iterations < 0 or self.tolerance <= 0:
            raise ValueError("max_iterations must not be negative and tolerance must be positive")

    @property
    def width(self) -> int:
        return self.dims // self.m


def sub_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, k) of sub-vectors to sub-centroids, folded component by component."""
    out = np.zeros((len(x), len(book)))
    for j in range(x.shape[1]):
        diff = x[:, j].astype(np.float64)[:, None] - book[:, j].astype(np.float64)[None, :]
        out += diff * diff
    return out


def encode_block(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes (rows, m) as bytes; of equally near sub-centroids the lowest."""
    m, _, w = books.shape
    return np.stack([sub_distances(x[:, j * w : (j + 1) * w], books[j]).argmin(axis=1) for j in range(m)], axis=1).astype(np.uint8)


@dataclass
class ProductQuantizer:
    """``books``: (m, k, width) float32."""

    cfg: PQConfig
    books: np.ndarray
    iterations: int = 0

    @classmethod
    def train(cls, vectors: DataFrame, cfg: PQConfig) -> "ProductQuantizer":
        """Euclidean k-means in every sub-space at once; each has its own hash-ordered start and stop."""
        n = vectors.count()
        if cfg.k > n:
            raise ValueError("k exceeds the number of vectors")
        books = np.zeros((cfg.m, cfg.k, cfg.width), np.float32)
        for j in range(cfg.m):
            first = first_by_hash(vectors.select("id", "vector"), hash_order(cfg.seed, F.lit(j), F.col("id")), "id", cfg.k, n).toArrow()
            books[j] = matrix(first.column("vector"))[:, j * cfg.width : (j + 1) * cfg.width]
        live = np.ones(cfg.m, bool)
        done = 0
        while done < cfg.max_iterations and live.any():
            new = _round(vectors, books, live)
            step = ((new.astype(np.float64) - books.astype(np.float64)) ** 2).sum(axis=2).mean(axis=1)
            books, live = new, live & (step >= cfg.tolerance)
            done += 1
        return cls(cfg, books, done)

    def code_table(self) -> DataFrame | pa.Table:
        m, k, w = self.books.shape
        return pa.table({"m": pa.array(np.repeat(np.arange(m), k), pa.int32()), "k": pa.array(np.tile(np.arange(k), m), pa.int32()), "sub_centroid": lists(self.books.reshape(m * k, w))})

    def encode(self, vectors: DataFrame) -> DataFrame:
        """``(id, codes)``: one byte per sub-vector."""
        sent = vectors.sparkSession.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), packed_codes(encode_block(matrix(b.column(1)), sent.value))], names=["id", "codes"])

        return vectors.select("id", "vector").mapInArrow(run, "id long, codes binary")

    def decode(self, codes: DataFrame) -> DataFrame:
        """``(id, vector)``: the sub-centroids side by side, not normalized again."""
        sent = codes.sparkSession.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), lists(decode_block(unpacked_codes(b.column(1), len(sent.value)), sent.value))], names=["id", "vector"])

        return codes.select("id", "codes").mapInArrow(run, "id long, vector array<float>")

    def distance_table(self, q: np.ndarray) -> np.ndarray:
        """(queries, m, k) squared distances of sub-vectors to sub-centroids."""
        w = self.cfg.width
        return np.stack([sub_distances(q[:, j * w : (j + 1) * w], self.books[j]) for j in range(self.cfg.m)], axis=1)

    def dot_table(self, q: np.ndarray) -> np.ndarray:
        """(queries, m, k) dot products of sub-vectors and sub-centroids."""
        w, out = self.cfg.width, []
        for j in range(self.cfg.m):
            t = np.zeros((len(q), self.cfg.k))
            for c in range(w):
                t += q[:, j * w + c].astype(np.float64)[:, None] * self.books[j, :, c].astype(np.float64)[None, :]
            out.append(t)
        return np.stack(out, axis=1)


def packed_codes(codes: np.ndarray) -> pa.Array:
    n, m = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * m, m, dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(np.ascontiguousarray(codes).tobytes())])


def unpacked_codes(column: pa.Array, m: int) -> np.ndarray:
    n = len(column)
    if n == 0:
        return np.zeros((0, m), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8, n * m, int(first)).reshape(n, m)


def decode_block(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[j][codes[:, j]] for j in range(len(books))], axis=1)


def table_sums(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows): the sum of the table entries a code points to."""
    out = np.zeros((len(table), len(codes)))
    for j in range(table.shape[1]):
        out += table[:, j, :][:, codes[:, j]]
    return out


def _round(vectors: DataFrame, books: np.ndarray, live: np.ndarray) -> np.ndarray:
    m, k, w = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast((books, live))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, on = sent.value
        total, count = np.zeros((m, k, w)), np.zeros((m, k), np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                for j in np.nonzero(on)[0]:
                    part = x[:, j * w : (j + 1) * w]
                    at = sub_distances(part, held[j]).argmin(axis=1)
                    np.add.at(total[j], at, part)
                    count[j] += np.bincount(at, minlength=k)
        jj, kk = np.nonzero(count)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(jj) + 1) * w, w, dtype=np.int32)), pa.array(total[jj, kk].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(jj.astype(np.int32)), pa.array(kk.astype(np.int32)), pa.array(count[jj, kk]), rows], names=["m", "k", "n", "s"])

    parts = vectors.select("vector").mapInArrow(partial, "m int, k int, n long, s array<double>")
    new = books.copy()
    for r in parts.groupBy("m", "k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(w)]).alias("s")).collect():  # m x k rows
        new[r["m"], r["k"]] = (np.array(r["s"]) / r["n"]).astype(np.float32)
    return new


def _adc_kernel(k: int):
    def best(payload, batch: pa.RecordBatch):
        qid, table = payload
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        d = table_sums(table, unpacked_codes(batch.column(1), table.shape[1]))
        if d.shape[1] > k:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            r, c = np.nonzero(d <= kth[:, None])
        else:
            r, c = np.nonzero(np.isfinite(d))
        return qid[r], ids[c], d[r, c]

    return best


@dataclass
class PQIndex:
    """Unit vectors as codes. The score is the squared asymmetric distance: lower is better."""

    quantizer: ProductQuantizer
    codes: DataFrame
    size: int

    @classmethod
    def build(cls, vectors: DataFrame, cfg: PQConfig) -> "PQIndex":
        n = check_vectors(vectors, "vector", cfg.dims)
        if n == 0:
            raise ValueError("no vectors to index")
        unit = cut(vectors.select(F.col("id").cast("long"), normalize(F.col("vector")).alias("vector")), "pq-unit")
        quantizer = ProductQuantizer.train(unit, cfg)
        return cls(quantizer, cut(quantizer.encode(unit), "pq-codes"), n)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if k == 0:
            return empty_result(queries)
        q = unit_queries(queries, self.quantizer.cfg.dims)
        blocks = (((t.column("query_id").to_numpy(), self.quantizer.distance_table(matrix(t.column("vector")))), self.codes) for t in query_blocks(q, "query_id", TABLE_BLOCK) if t.num_rows)
        found = scan(blocks, _adc_kernel(k), k, ascending=True)
        return empty_result(queries) if found is None else found

    def bytes_per_vector(self) -> int:
        return self.quantizer.cfg.m

    def total_bytes(self) -> int:
        return self.codes.agg(F.coalesce(F.sum(F.length("codes")), F.lit(0))).first()[0]
