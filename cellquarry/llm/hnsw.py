"""A hierarchical navigable small-world graph in numpy.

Vectors are inserted in batches.  A batch searches the graph so far with all its
vectors side by side and also sees its own members; links are chosen by the
diversity rule (a candidate is linked if it is closer to the new vector than to
any link already chosen).  Searches advance many queries at once: each step
expands the best few unexpanded members of every query's beam.
"""

from __future__ import annotations

import io

import numpy as np

LINKS = 12
BUILD_BEAM = 32
BATCH = 256
EXPAND = 4


class Graph:
    """Unit vectors (float32) and, for each level, neighbours padded with -1."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 17) -> None:
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        top = np.floor(-np.log(rng.random(n) + 1e-12) / np.log(links)).astype(np.int64) if n else np.zeros(0, np.int64)
        self.height = int(min(top.max(initial=0), 6))
        self.level = np.minimum(top, self.height)
        self.near = [np.full((n, links * 2 if lv == 0 else links), -1, np.int32) for lv in range(self.height + 1)]
        self.entry, self.reached = -1, -1
        for start in range(0, n, BATCH):
            self._insert(np.arange(start, min(start + BATCH, n)), beam)

    def _insert(self, new: np.ndarray, beam: int) -> None:
        v = self.vectors
        old_entry, old_reached = self.entry, self.reached
        mutual = v[new] @ v[new].T
        np.fill_diagonal(mutual, -np.inf)
        starts = np.full((len(new), 1), old_entry, np.int64)
        for level in range(self.height, -1, -1):
            here = np.flatnonzero(self.level[new] >= level)
            ids, sims = np.full((len(new), 0), -1), np.zeros((len(new), 0))
            if 0 <= level <= old_reached:
                ids, sims = self._beam(v[new], starts, level, beam if level <= self.level[new].max() else 1)
                starts = ids
            if len(here):
                k = min(beam, len(here))
                own = mutual[np.ix_(here, here)]
                best = np.argpartition(-own, k - 1, axis=1)[:, :k]
                own_sims = np.take_along_axis(own, best, 1)
                cand = np.concatenate([ids[here], np.where(np.isfinite(own_sims), new[here][best], -1)], 1)
                near = np.concatenate([sims[here], own_sims], 1)
                chosen = self._choose(cand, np.where(cand >= 0, near, -np.inf), self.near[level].shape[1] // (2 if level == 0 else 1))
                self.near[level][new[here], : chosen.shape[1]] = chosen
                self._back(new[here], chosen, level)
        high = int(new[self.level[new].argmax()])
        if self.level[high] > self.reached:
            self.entry, self.reached = high, int(self.level[high])

    def _choose(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Diverse choice of links for each row of candidates (-1: none)."""
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        use = min(cand.shape[1], max(2 * most, int((cand >= 0).sum(1).max(initial=1))))
        cand, sims = cand[:, :use], sims[:, :use]
        rows, width = cand.shape
        chosen, count = np.full((rows, most), -1, np.int64), np.zeros(rows, np.int64)
        vectors = self.vectors[np.maximum(cand, 0)]
        nearer = np.matmul(vectors, vectors.transpose(0, 2, 1)) > sims[:, :, None]  # [row, j, i]: j is nearer to i than to the new vector
        real, taken, shaded = cand >= 0, np.zeros((rows, width), bool), np.zeros((rows, width), bool)
        for j in range(width):
            r = np.flatnonzero(real[:, j] & ~shaded[:, j] & (count < most))
            if len(r):
                taken[r, j] = True
                count[r] += 1
                shaded[r] |= nearer[r, :, j]
        place = np.where(taken, np.cumsum(taken, axis=1) - 1, 0)
        left = real & ~taken  # then fill with the nearest of those left
        place = np.where(left, count[:, None] + np.cumsum(left, axis=1) - 1, place)
        r, c = np.nonzero((taken | left) & (place < most))
        chosen[r, place[r, c]] = cand[r, c]
        return chosen

    def _back(self, source: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Links back to the sources; overfull nodes choose again."""
        near = self.near[level]
        real = chosen >= 0
        target, origin = chosen[real], np.repeat(source, real.sum(1))
        order = np.argsort(target, kind="stable")
        target, origin = target[order], origin[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        width = near.shape[1]
        extra = np.full((len(nodes), int(n.max(initial=0))), -1, np.int64)
        row = np.repeat(np.arange(len(nodes)), n)
        extra[row, np.arange(len(target)) - first[row]] = origin
        if extra.shape[1] > 4 * width:  # a hub: its nearest are enough to choose from
            sims = np.where(extra >= 0, np.einsum("rjd,rd->rj", self.vectors[np.maximum(extra, 0)], self.vectors[nodes]), -np.inf)
            extra = np.take_along_axis(extra, np.argpartition(-sims, 4 * width - 1, axis=1)[:, : 4 * width], 1)
        cand = np.concatenate([near[nodes].astype(np.int64), extra], 1)
        cand[cand == nodes[:, None]] = -1
        cand = np.sort(cand, axis=1)[:, ::-1]
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        full = (cand >= 0).sum(1) > width
        packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)
        near[nodes] = packed[:, :width] if packed.shape[1] >= width else np.pad(packed, ((0, 0), (0, width - packed.shape[1])), constant_values=-1)
        for a in range(0, int(full.sum()), BATCH):
            at = np.flatnonzero(full)[a : a + BATCH]
            sims = np.einsum("rjd,rd->rj", self.vectors[np.maximum(cand[at], 0)], self.vectors[nodes[at]])
            near[nodes[at]] = self._choose(cand[at], np.where(cand[at] >= 0, sims, -np.inf), width)

    def _beam(self, queries: np.ndarray, starts: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best members found on a level (ids -1 and -inf where fewer)."""
        q, near, v = len(queries), self.near[level], self.vectors
        seen = np.zeros((q, len(v) + 1), bool)  # the last column stands for "none"
        seen[:, -1] = True
        rows = np.arange(q)[:, None]
        ids, sims = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf, np.float32)
        k = min(starts.shape[1], beam)
        first = starts[:, :k]
        ids[:, :k] = first
        sims[:, :k] = np.where(first >= 0, np.einsum("qkd,qd->qk", v[np.maximum(first, 0)], queries), -np.inf)
        seen[rows, first] = True
        done = ids < 0
        active = np.arange(q)
        while len(active):
            waiting = np.where(done[active], -np.inf, sims[active])
            e = min(EXPAND, beam)
            pick = np.argpartition(-waiting, e - 1, axis=1)[:, :e] if e < beam else np.broadcast_to(np.arange(beam), waiting.shape)
            alive = np.take_along_axis(waiting, pick, 1) > -np.inf
            some = alive.any(1)
            active, pick, alive = active[some], pick[some], alive[some]
            if not len(active):
                break
            done[active[:, None], pick] = True
            nodes = np.where(alive, ids[active[:, None], pick], -1)
            fresh = np.where(nodes[:, :, None] >= 0, near[np.maximum(nodes, 0)], -1).reshape(len(active), -1).astype(np.int64)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[seen[active[:, None], fresh]] = -1
            seen[active[:, None], fresh] = True
            got = np.where(fresh >= 0, np.einsum("qkd,qd->qk", v[np.maximum(fresh, 0)], queries[active]), -np.inf)
            all_ids = np.concatenate([ids[active], fresh], 1)
            all_sims = np.concatenate([sims[active], got], 1)
            all_done = np.concatenate([done[active], fresh < 0], 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1) | (ids[active] < 0)
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities (unordered) of each query's beam on the lowest level."""
        queries = np.asarray(queries, np.float32)
        starts = np.full((len(queries), 1), self.entry, np.int64)
        for level in range(self.reached, 0, -1):
            starts, _ = self._beam(queries, starts, level, 1)
        return self._beam(queries, starts, 0, min(beam, len(self.vectors)))

    def around(self, members: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """As `search` for vectors of the graph itself, which start at their own place."""
        return self._beam(self.vectors[members], np.asarray(members)[:, None], 0, min(beam, len(self.vectors)))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, top=np.array([self.entry, self.reached, self.height]), level=self.level, **{f"near{i}": x for i, x in enumerate(self.near)})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes, vectors: np.ndarray) -> Graph:
        out = object.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            out.vectors = np.ascontiguousarray(vectors, np.float32)
            out.entry, out.reached, out.height = map(int, z["top"])
            out.level, out.near = z["level"], [z[f"near{i}"] for i in range(out.height + 1)]
        return out
