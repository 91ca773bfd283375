"""A robust-pruned directed graph over unit vectors, built and searched in batches.

A node's edges are what a greedy search for it met, pruned: a candidate is dropped
when a kept, closer neighbour is nearer to it by the factor ``alpha``, so kept edges
point in diverse directions; where they leave room, the nearest of the dropped fill it up to
``fill`` edges, so that tight groups stay linked. A search begins at the nearest of some
nodes drawn at random, so none depends on a path from one entry. Searches keep a beam of the best nodes met and expand
several of them at once; many searches run side by side in NumPy.
"""

from __future__ import annotations

import ctypes
import glob
import os
from functools import cache

import numpy as np

FAR = np.float32(9.0)


@cache
def one_thread() -> None:
    """Keeps NumPy's linear algebra to the task's own core, where its library has a switch for that.

    The matrices here are small, and threads that wait for each other take the time of other tasks.
    """
    for at in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(at), name)(1)
                return
            except (AttributeError, OSError):
                continue


class Graph:
    """Graph of one shard. ``vectors`` are float32 rows of unit length."""

    def __init__(
        self, vectors: np.ndarray, degree: int = 24, beam: int = 32, alpha: float = 1.2, width: int = 4, seed: int = 7, fill: int = 16, entries: int = 512
    ):
        self.v = np.ascontiguousarray(vectors, dtype=np.float32)
        self.n = len(self.v)
        self.degree, self.beam, self.alpha, self.width, self.fill = degree, beam, np.float32(alpha), width, min(fill, degree)
        self.slack = degree + degree // 2
        self.edges = np.full((self.n, self.slack), -1, dtype=np.int32)
        self.filled = np.zeros(self.n, dtype=np.int32)
        order = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        self.entries = order[:entries]
        if self.n:
            self._build(order)

    # building

    def _build(self, order: np.ndarray) -> None:
        first = order[: min(self.n, 4 * self.beam)]
        near = np.argsort(-(self.v[first] @ self.v[first].T), axis=1)[:, : 2 * self.degree + 1].astype(np.int32)
        self._link(first, first[near])
        done = len(first)
        while done < self.n:
            batch = order[done : done + min(max(done, 64), 1024)]
            found, _ = self.search(self.v[batch], self.starts(self.v[batch], self.entries[:done]))
            self._link(batch, found)
            done += len(batch)

    def _link(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        kept = self.pruned(nodes, candidates)
        self.edges[nodes, : self.degree] = kept
        self.edges[nodes, self.degree :] = -1
        self.filled[nodes] = (kept >= 0).sum(axis=1)
        self._link_back(np.repeat(nodes, self.degree), kept.ravel())

    def _link_back(self, sources: np.ndarray, targets: np.ndarray) -> None:
        ok = targets >= 0
        order = np.argsort(targets[ok], kind="stable")
        targets, sources = targets[ok][order], sources[ok][order]
        at, start, count = np.unique(targets, return_index=True, return_counts=True)
        rank = np.arange(len(targets)) - np.repeat(start, count)
        room = self.filled[at] + count <= self.slack
        easy = np.repeat(room, count)
        t, s, r = targets[easy], sources[easy], rank[easy]
        self.edges[t, self.filled[t] + r] = s
        self.filled[at[room]] += count[room].astype(np.int32)
        tight = at[~room]
        if len(tight):
            most = int(count[~room].max())
            new = np.full((len(tight), most), -1, dtype=np.int32)
            row = np.repeat(np.arange(len(tight)), count[~room])
            new[row, rank[~easy]] = sources[~easy]
            for i in range(0, len(tight), 1024):
                part = tight[i : i + 1024]
                kept = self.pruned(part, np.concatenate([self.edges[part], new[i : i + 1024]], axis=1))
                self.edges[part, : self.degree] = kept
                self.edges[part, self.degree :] = -1
                self.filled[part] = (kept >= 0).sum(axis=1)

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to ``degree`` diverse neighbours of each node among its candidates (-1: none)."""
        c = candidates
        x = self.v[np.maximum(c, 0)]
        far = 1 - np.matmul(x, self.v[nodes][:, :, None])[:, :, 0]
        far[(c < 0) | (c == nodes[:, None])] = FAR
        width = min(c.shape[1], 2 * self.degree)
        order = np.argsort(far, axis=1)[:, :width]
        far = np.take_along_axis(far, order, axis=1)
        c = np.take_along_axis(c, order, axis=1)
        x = np.take_along_axis(x, order[:, :, None], axis=1)
        between = (1 - np.matmul(x, x.transpose(0, 2, 1))) * self.alpha
        # a node met twice counts once
        by_id = np.argsort(c, axis=1, kind="stable")
        same = np.take_along_axis(c, by_id, axis=1)
        again = np.zeros(c.shape, dtype=bool)
        np.put_along_axis(again, by_id[:, 1:], same[:, 1:] == same[:, :-1], axis=1)
        left = (far < FAR) & ~again
        alive = left.copy()
        out = np.full((len(nodes), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            pick = alive.argmax(axis=1)
            live = alive[rows, pick]
            if not live.any():
                break
            out[live, k] = c[rows[live], pick[live]]
            left[rows[live], pick[live]] = False
            alive &= between[rows, pick] > far
            alive[rows, pick] = False
        have = (out >= 0).sum(axis=1)
        rank = np.cumsum(left, axis=1)
        row, col = np.nonzero(left & (rank <= (self.fill - have)[:, None]))
        out[row, have[row] + rank[row, col] - 1] = c[row, col]
        return out

    # searching

    def starts(self, queries: np.ndarray, entries: np.ndarray | None = None, k: int = 4) -> np.ndarray:
        """The k nearest of the entries to each query."""
        entries = self.entries if entries is None else entries
        k = min(k, len(entries))
        return entries[np.argpartition(-(queries @ self.v[entries].T), k - 1, axis=1)[:, :k]]

    def search(self, queries: np.ndarray, starts: np.ndarray | None = None, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (1 - cosine) of the beam of each query, nearest first; -1 fills up.

        ``starts`` has one or more nodes a query; without it they are the nearest entries.
        """
        starts = self.starts(queries) if starts is None else starts.reshape(len(queries), -1)
        ids, far = [], []
        block = max(1, min(1024, 40_000_000 // max(self.n, 1)))
        for i in range(0, len(queries), block):
            a, b = self._search(queries[i : i + block], starts[i : i + block], max(beam or self.beam, starts.shape[1]))
            ids.append(a)
            far.append(b)
        return np.concatenate(ids), np.concatenate(far)

    def _search(self, q: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m, n, w = len(q), self.n, self.width
        ids = np.full((m, beam), -1, dtype=np.int32)
        far = np.full((m, beam), FAR, dtype=np.float32)
        open_ = np.zeros((m, beam), dtype=bool)
        k = starts.shape[1]
        away = 1 - np.matmul(self.v[starts], q[:, :, None])[:, :, 0]
        for j in range(1, k):
            away[(starts[:, :j] == starts[:, j : j + 1]).any(axis=1), j] = FAR
        order = np.argsort(away, axis=1, kind="stable")
        far[:, :k] = np.take_along_axis(away, order, axis=1)
        ids[:, :k] = np.where(far[:, :k] < FAR, np.take_along_axis(starts, order, axis=1), -1)
        open_[:, :k] = ids[:, :k] >= 0
        seen = np.zeros(m * n, dtype=bool)
        mark = np.empty(m * n, dtype=np.int32)
        seen[(np.arange(m)[:, None] * n + starts).ravel()] = True
        active = np.arange(m)
        while len(active):
            o = open_[active]
            rank = np.cumsum(o, axis=1)
            chosen = o & (rank <= w)
            row, col = np.nonzero(chosen)
            open_[active[row], col] = False
            node = ids[active[row], col]
            nbr = self.edges[node]
            ok = nbr >= 0
            r = np.repeat(row, ok.sum(axis=1))
            nbr = nbr[ok]
            flat = active[r] * n + nbr
            fresh = ~seen[flat]
            r, nbr, flat = r[fresh], nbr[fresh], flat[fresh]
            mark[flat] = np.arange(len(flat), dtype=np.int32)
            fresh = mark[flat] == np.arange(len(flat), dtype=np.int32)
            r, nbr, flat = r[fresh], nbr[fresh], flat[fresh]
            seen[flat] = True
            d = 1 - np.einsum("ij,ij->i", q[active[r]], self.v[nbr])
            # r is ascending: lay the new nodes out beside the beam
            count = np.bincount(r, minlength=len(active))
            most = int(count.max()) if len(count) else 0
            if most:
                pos = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                new_far = np.full((len(active), most), FAR, dtype=np.float32)
                new_ids = np.full((len(active), most), -1, dtype=np.int32)
                new_far[r, pos] = d
                new_ids[r, pos] = nbr
                all_far = np.concatenate([far[active], new_far], axis=1)
                all_ids = np.concatenate([ids[active], new_ids], axis=1)
                all_open = np.concatenate([open_[active], new_ids >= 0], axis=1)
                order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
                part = np.take_along_axis(all_far, order, axis=1)
                order = np.take_along_axis(order, np.argsort(part, axis=1), axis=1)
                far[active] = np.take_along_axis(all_far, order, axis=1)
                ids[active] = np.take_along_axis(all_ids, order, axis=1)
                open_[active] = np.take_along_axis(all_open, order, axis=1)
            active = active[open_[active].any(axis=1)]
        return ids, far
