"""Hierarchical navigable small-world graphs over one shard of unit vectors, built and searched in batches with NumPy."""

from __future__ import annotations

import io

import numpy as np

LINKS, BEAM, BATCH = 16, 64, 256
#: Candidates that a search opens in one step, for each query.
OPENED = 4


def chosen(vectors: np.ndarray, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` candidates a row, best first: those nearer to the row's query than to a candidate chosen before,
    then the best of the rest. Candidates are sorted by score; -1 stands for none."""
    rows, width = candidates.shape
    kept, n = np.full((rows, most), -1, dtype=np.int32), np.zeros(rows, dtype=np.int64)
    spare = np.zeros((rows, width), dtype=bool)
    held = np.zeros((rows, most, vectors.shape[1]), dtype=np.float32)
    for k in range(width):
        c = candidates[:, k]
        alive = (c >= 0) & (n < most)
        if not alive.any():
            continue
        near = np.einsum("rmd,rd->rm", held, vectors[c])
        near[np.arange(most)[None, :] >= n[:, None]] = -2.0
        good = alive & (near.max(axis=1) < scores[:, k])
        r = np.flatnonzero(good)
        kept[r, n[r]], held[r, n[r]] = c[r], vectors[c[r]]
        n[r] += 1
        spare[:, k] = alive & ~good
    for k in range(width):
        r = np.flatnonzero(spare[:, k] & (n < most))
        kept[r, n[r]] = candidates[r, k]
        n[r] += 1
    return kept


class Graph:
    """levels[k]: adjacency (node, LINKS << (k == 0)) with -1 for none; nodes are ordered from the highest level down."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray]):
        self.vectors, self.levels = vectors, levels

    @classmethod
    def built(cls, vectors: np.ndarray, draw: np.ndarray) -> tuple[Graph, np.ndarray]:
        """vectors: unit rows; draw: a number in (0, 1) for each. Returns the graph and the order of its nodes."""
        level = np.minimum(np.floor(-np.log(draw) / np.log(LINKS)), 8).astype(int)
        order = np.lexsort((draw, -level))
        vectors, level = np.ascontiguousarray(vectors[order]), level[order]
        counts = [int((level >= k).sum()) for k in range(level.max() + 1)] if len(level) else [0]
        graph = cls(vectors, [np.full((c, LINKS << (k == 0)), -1, dtype=np.int32) for k, c in enumerate(counts)])
        done = min(1, len(vectors))
        while done < len(vectors):
            new = np.arange(done, min(len(vectors), done + min(BATCH, done)))
            graph.insert(new, level[new], done)
            done = int(new[-1]) + 1
        return graph, order

    def insert(self, new: np.ndarray, level: np.ndarray, done: int) -> None:
        q = self.vectors[new]
        entry = np.zeros((len(new), 1), dtype=np.int32)
        among = q @ q.T
        for k in range(len(self.levels) - 1, -1, -1):
            entry, score = self.beam(q, entry, BEAM if (level >= k).any() else 1, k, done)
            at = np.flatnonzero(level >= k)
            if not len(at):
                continue
            # Rows of one batch see each other, too.
            own = among[np.ix_(at, at)].copy()
            np.fill_diagonal(own, -2.0)
            near = np.argsort(-own, axis=1)[:, : 2 * LINKS]
            c = np.concatenate([entry[at], new[at][near]], axis=1)
            s = np.concatenate([score[at], np.take_along_axis(own, near, axis=1)], axis=1)
            c[s <= -2.0] = -1
            by = np.argsort(-s, axis=1, kind="stable")
            c, s = np.take_along_axis(c, by, axis=1), np.take_along_axis(s, by, axis=1)
            picked = chosen(self.vectors, c, s, LINKS)
            self.levels[k][new[at], :LINKS] = picked
            self.link_back(k, np.repeat(new[at], LINKS), picked.ravel())

    def link_back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        adjacency = self.levels[k]
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, start, n = np.unique(target, return_index=True, return_counts=True)
        incoming = np.full((len(nodes), n.max(initial=0)), -1, dtype=np.int32)
        incoming[np.repeat(np.arange(len(nodes)), n), np.arange(len(target)) - np.repeat(start, n)] = source
        c = np.concatenate([adjacency[nodes], incoming], axis=1)
        c.sort(axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        s = np.einsum("rcd,rd->rc", self.vectors[c], self.vectors[nodes])
        s[c < 0] = -2.0
        by = np.argsort(-s, axis=1, kind="stable")
        c, s = np.take_along_axis(c, by, axis=1), np.take_along_axis(s, by, axis=1)
        adjacency[nodes] = chosen(self.vectors, c, s, adjacency.shape[1])

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, k: int, done: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes of level k that the search meets, best first (-1, -2.0 for none)."""
        adjacency = self.levels[k]
        n = min(len(adjacency), done) if done is not None else len(adjacency)
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), dtype=bool)  # the last column takes what isn't there
        seen[:, n] = True
        entry = np.where((entry < 0) | (entry >= n), n, entry)
        fresh = ~seen[rows, entry]
        seen[rows, entry] = True
        ids = np.where(fresh, entry, -1).astype(np.int32)
        scores = np.where(fresh, np.einsum("rcd,rd->rc", self.vectors[np.minimum(entry, n - 1)], q), np.float32(-2.0)).astype(np.float32)
        opened = np.zeros(ids.shape, dtype=bool)
        while True:
            closed = np.where(opened | (ids < 0), np.float32(-3.0), scores)
            top = np.argsort(-closed, axis=1, kind="stable")[:, : min(OPENED, width)]
            live = np.take_along_axis(closed, top, axis=1) > -2.5
            if not live.any():
                break
            np.put_along_axis(opened, top, np.take_along_axis(opened, top, axis=1) | live, axis=1)
            node = np.take_along_axis(ids, top, axis=1)
            c = np.where(live[:, :, None], adjacency[node], -1).reshape(len(q), -1)
            c = np.where((c < 0) | (c >= n), n, c)
            c.sort(axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = n
            fresh = ~seen[rows, c]
            seen[rows, c] = True
            s = np.full(c.shape, -2.0, dtype=np.float32)
            r, x = np.nonzero(fresh)
            s[r, x] = np.einsum("id,id->i", self.vectors[c[r, x]], q[r])
            ids = np.concatenate([ids, np.where(fresh, c, -1).astype(np.int32)], axis=1)
            scores, opened = np.concatenate([scores, s], axis=1), np.concatenate([opened, np.zeros(c.shape, dtype=bool)], axis=1)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :width]
            ids, scores, opened = (np.take_along_axis(x, best, axis=1) for x in (ids, scores, opened))
        return ids, scores

    def within(self, q: np.ndarray, least: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a score of at least `least`.

        A beam that ends full of such nodes is widened; one that would take in a quarter of the nodes scans them all.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, n = np.arange(len(q)), len(self.vectors)
        while len(waiting):
            scan = 4 * width >= n
            rest = [waiting[:0]]
            for a in range(0, len(waiting), BATCH):
                at = waiting[a : a + BATCH]
                if scan:
                    r, c = np.nonzero(q[at] @ self.vectors.T >= least)
                    found.append((at[r], c))
                    continue
                entry = np.zeros((len(at), 1), dtype=np.int32)
                for k in range(len(self.levels) - 1, 0, -1):
                    entry, _ = self.beam(q[at], entry, 4, k)
                ids, scores = self.beam(q[at], entry, width, 0)
                full = (scores[:, -1] >= least) & (ids.shape[1] >= width)
                r, c = np.nonzero((scores >= least) & ~full[:, None])
                found.append((at[r], ids[r, c]))
                rest.append(at[full])
            waiting, width = np.concatenate(rest), 4 * width
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in found]).astype(np.int64), np.concatenate([x[1] for x in found]).astype(np.int64)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"level{k}": x for k, x in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        return cls(held["vectors"], [held[f"level{k}"] for k in range(len(held.files) - 1)])
