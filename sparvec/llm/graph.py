"""A robust-pruned directed graph over one shard of unit vectors, and its batched beam search.

Records are inserted in batches of growing size. A batch's records search the graph as it stands
(greedy beam search); what they expanded and kept proposes their neighbours; relaxed distance
pruning keeps an edge p -> c only if no nearer kept neighbour n of p satisfies
alpha * dist(n, c) <= dist(p, c), so edges stay diverse; places left over go to the nearest struck
out. Back edges are added and overfull nodes are pruned by the same rule. A walk starts at the
nearest of a bounded set of entry rows (its share grows with the graph up to the bound), since a greedy walk from one row strays between clusters
that have nothing in common. All queries of a block walk in step, so each step is a few numpy calls.

Distances are squared Euclidean, which for unit vectors is 2 - 2 cos and ranks alike.
"""

from __future__ import annotations

import numpy as np


def robust_prune(x: np.ndarray, base: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each base row, nearest first; -1 pads.

    ``cand`` (B, C) holds candidate rows (-1 for none) and ``dist`` their squared distances to the base (inf for none).
    """
    # farther ones would be struck out or not fit
    if dist.shape[1] > 8 * degree:
        near = np.argpartition(dist, 2 * degree - 1, axis=1)[:, : 2 * degree]
        cand, dist = np.take_along_axis(cand, near, axis=1), np.take_along_axis(dist, near, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * degree]
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    rows, width = cand.shape
    v = x[np.maximum(cand, 0)]
    between = 2.0 - 2.0 * np.matmul(v, v.transpose(0, 2, 1))
    between *= alpha
    alive = np.isfinite(dist)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]  # equal candidates have equal distances and are neighbours here
    usable = alive.copy()
    kept = np.zeros_like(alive)
    filled = np.zeros(rows, np.int64)
    for c in range(width):  # nearest first: a candidate still alive is kept and strikes out what it covers
        take = np.nonzero(alive[:, c] & (filled < degree))[0]
        if not len(take):
            continue
        kept[take, c] = True
        filled[take] += 1
        if c + 1 < width:
            alive[take, c + 1 :] &= between[take, c, c + 1 :] > dist[take, c + 1 :]
    # kept ones first, then the nearest of the rest
    rank = np.where(kept, 0, np.where(usable, 1, 2)).astype(np.int64) * width + np.arange(width)
    best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(usable, best, axis=1), np.take_along_axis(cand, best, axis=1), -1).astype(np.int32)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out


#: (query, row) pairs that a search keeps marks of at once.
STAMPS = 16_000_000


class Graph:
    """Built over ``x`` (unit rows, float32)."""

    def __init__(self, x: np.ndarray, degree: int = 20, beam: int = 24, alpha: float = 1.3, block: int = 512, entries: int = 8192, grow: int = 8, seed: int = 42, least: float | None = None) -> None:
        """``least``: keep the pairs of at least this cosine that insertion meets, see ``met``."""
        n = len(x)
        block = min(block, max(16, STAMPS // max(1, n)))
        self.x, self.degree, self.beam, self.alpha, self.block = x, degree, beam, alpha, block
        self._most = None if least is None else 2.0 - 2.0 * least + 1e-5
        self._met: list[tuple[np.ndarray, np.ndarray]] = []
        self.slack = degree + degree // 2
        self.edges = np.full((n, self.slack), -1, np.int32)
        self.count = np.zeros(n, np.int64)
        self.entries = np.arange(min(n, 1))
        self.work = 0  # distances computed
        if n < 2:
            return
        order = np.random.default_rng(seed).permutation(n)
        first = min(n, 512)
        self.entries = order[:first]
        self._start(order[:first])
        done = first
        while done < n:
            batch = order[done : done + min(max(64, done // grow), block)]
            self._insert(batch)
            done += len(batch)
            self.entries = order[: min(done, entries)]

    def _start(self, rows: np.ndarray) -> None:
        d = 2.0 - 2.0 * (self.x[rows] @ self.x[rows].T)
        np.fill_diagonal(d, np.inf)
        self._meet(rows, np.broadcast_to(rows, d.shape), d)
        self._set(rows, robust_prune(self.x, rows, np.broadcast_to(rows.astype(np.int32), d.shape), d, self.degree, self.alpha))

    def _set(self, rows: np.ndarray, out: np.ndarray) -> None:
        self.edges[rows] = -1
        self.edges[rows, : out.shape[1]] = out
        self.count[rows] = (out >= 0).sum(axis=1)

    def _meet(self, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        if self._most is not None:
            r, c = np.nonzero(dist <= self._most)
            self._met.append((rows[r], ids[r, c].astype(np.int64)))

    def met(self) -> tuple[np.ndarray, np.ndarray]:
        """The close pairs that insertion met, each once, the lower row first."""
        if not self._met:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(c) for c in zip(*self._met))
        low, high = np.divmod(np.unique(np.minimum(a, b) * len(self.x) + np.maximum(a, b)), len(self.x))
        return low, high

    def _insert(self, batch: np.ndarray) -> None:
        for s in range(0, len(batch), self.block):
            rows = batch[s : s + self.block]
            ids, dist, seen, seen_dist = self.search(self.x[rows], self.beam, trace=True)
            # records of one batch cannot find each other in the graph: their nearest are proposed directly
            own = 2.0 - 2.0 * (self.x[rows] @ self.x[rows].T)
            np.fill_diagonal(own, np.inf)
            self._meet(rows, ids, dist)
            self._meet(rows, np.broadcast_to(rows, own.shape), own)
            few = min(4, len(rows) - 1)
            mates = np.argpartition(own, few - 1, axis=1)[:, :few] if few > 0 else np.zeros((len(rows), 0), np.int64)
            cand = np.concatenate([ids, seen, rows[mates].astype(np.int32)], axis=1)
            d = np.concatenate([dist, seen_dist, np.take_along_axis(own, mates, axis=1)], axis=1)
            self._set(rows, robust_prune(self.x, rows, cand, d, self.degree, self.alpha))
        # back edges
        out = self.edges[batch, : self.degree]
        src = np.repeat(batch, self.degree).astype(np.int32)
        dst = out.ravel()
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        near = 2.0 - 2.0 * np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((near, dst))
        src, dst = src[order], dst[order]
        heads, start, size = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(start, size)
        at = self.count[dst] + place
        fits = (np.repeat(self.count[heads] + size, size)) <= self.slack
        self.edges[dst[fits], at[fits]] = src[fits]
        easy = self.count[heads] + size <= self.slack
        self.count[heads[easy]] += size[easy]
        full = heads[~easy]
        if not len(full):
            return
        # overfull: prune old and nearest new neighbours together
        width = self.slack + 2 * self.degree
        for s in range(0, len(full), self.block):
            rows = full[s : s + self.block]
            cand = np.full((len(rows), width), -1, np.int32)
            cand[:, : self.slack] = self.edges[rows]
            spot = np.full(len(self.x), -1, np.int64)
            spot[rows] = np.arange(len(rows))
            mine = (spot[dst] >= 0) & (place < 2 * self.degree)
            cand[spot[dst[mine]], self.slack + place[mine]] = src[mine]
            d = 2.0 - 2.0 * np.einsum("bd,bcd->bc", self.x[rows], self.x[np.maximum(cand, 0)])
            d[cand < 0] = np.inf
            self._set(rows, robust_prune(self.x, rows, cand, d, self.degree, self.alpha))

    def search(self, q: np.ndarray, beam: int, start: np.ndarray | None = None, trace: bool = False, wide: int = 8):
        """The ``beam`` nearest rows found for each query, nearest first: ids (-1 pads) and squared distances.

        ``start``: a row to start from for each query, besides the entries. ``trace``: also the rows expanded.
        """
        x, edges, n, m = self.x, self.edges, len(self.x), len(q)
        rows = np.arange(m)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        stamp = np.full(m * n, -1, np.int32)  # which step's pair reached (query, row) last; -1: not reached
        # the nearest entry of each of a few shares of them: the nearest of all is among these
        doors = np.stack([e[(q @ x[e].T).argmax(axis=1)] for e in np.array_split(self.entries, min(wide, beam, len(self.entries)))], axis=1)
        begin = list(doors.T.astype(np.int32)) + ([start.astype(np.int32)] if start is not None else [])
        for j, b in enumerate(begin[: beam]):
            cell = rows * n + b
            fresh = stamp[cell] < 0
            ids[fresh, j], dist[fresh, j], open_[fresh, j] = b[fresh], (2.0 - 2.0 * np.einsum("ij,ij->i", q, x[b]))[fresh], True
            stamp[cell] = 0
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist, open_ = (np.take_along_axis(a, order, axis=1) for a in (ids, dist, open_))
        traced, traced_d = [], []
        live = rows
        while len(live):
            o = open_[live]
            rank = np.cumsum(o, axis=1)
            pick = o & (rank <= wide)  # the nearest unexpanded rows
            r, c = np.nonzero(pick)
            node = ids[live[r], c]
            open_[live[r], c] = False
            if trace:
                t = np.full((m, wide), -1, np.int32)
                td = np.full((m, wide), np.inf, np.float32)
                k = rank[r, c] - 1
                t[live[r], k], td[live[r], k] = node, dist[live[r], c]
                traced.append(t)
                traced_d.append(td)
            nb = edges[node]
            cell = (live[r] * n)[:, None] + nb
            cell = cell[nb >= 0]
            cell = cell[stamp[cell] < 0]
            turn = np.arange(len(cell), dtype=np.int32)
            stamp[cell] = turn
            cell = cell[stamp[cell] == turn]  # a row reached twice in this step counts once
            qr = cell // n
            nr = (cell - qr * n).astype(np.int32)
            d = (2.0 - 2.0 * np.einsum("ij,ij->i", q[qr], x[nr])).astype(np.float32)
            self.work += len(d)
            worst = dist[qr, beam - 1]
            ok = d < worst
            qr, nr, d = qr[ok], nr[ok], d[ok]
            if len(qr):
                edge = np.nonzero(np.concatenate([[True], qr[1:] != qr[:-1]]))[0]  # pairs come in order of query
                who, first, size = qr[edge], edge, np.diff(np.append(edge, len(qr)))
                width = int(size.max())
                add_d = np.full((len(who), width), np.inf, np.float32)
                add_i = np.full((len(who), width), -1, np.int32)
                w = np.repeat(np.arange(len(who)), size)
                p = np.arange(len(qr)) - np.repeat(first, size)
                add_d[w, p], add_i[w, p] = d, nr
                all_d = np.concatenate([dist[who], add_d], axis=1)
                all_i = np.concatenate([ids[who], add_i], axis=1)
                all_o = np.concatenate([open_[who], add_i >= 0], axis=1)
                order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
                dist[who], ids[who], open_[who] = (np.take_along_axis(a, order, axis=1) for a in (all_d, all_i, all_o))
            live = live[open_[live].any(axis=1)]
        if trace:
            return ids, dist, np.concatenate(traced, axis=1) if traced else ids[:, :0], np.concatenate(traced_d, axis=1) if traced_d else dist[:, :0]
        return ids, dist
