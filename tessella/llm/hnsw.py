"""Hierarchical navigable small-world graph in flat arrays, searched with blocks of queries."""

from __future__ import annotations

import numpy as np


class FlatHNSW:
    """Graph over unit vectors; each layer is one array of neighbours (rows + 1, degree), -1 for none
    and in the last row.

    Layers are filled from the top: the members of a layer are the first nodes of the layer
    below.  Nodes are inserted in blocks: a block is searched in the graph so far, compared with
    itself, linked to diverse near nodes, and linked back from them where it is nearer than what
    they have.  The lowest layer is filled by neighbourhood: its blocks are the leaves of a tree
    of random cuts, so most near nodes stand in the block itself, and islands that no path leads
    to are linked all the same; the leaves of ``trees`` - 1 further trees are compared with
    themselves afterwards, for what the cuts of the first parted.  ``near`` keeps, for every
    node, the best nodes met in either direction.
    """

    def __init__(self, x: np.ndarray, *, degree: int = 12, ef: int = 16, keep: int = 12, seed: int = 5, shrink: int = 16, trees: int = 3, leaf: int = 1024, hints: np.ndarray | None = None):
        """``hints`` (rows, h): hashes under which similar vectors often agree; a node also enters
        the graph at the last node before it with its hash, which leads into islands that the
        sparse upper layers miss."""
        self.x, self.degree, self.ef, self.keep = np.ascontiguousarray(x, np.float32), degree, ef, keep
        n = len(x)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        sizes = [n]
        while sizes[-1] > 256:
            sizes.append(sizes[-1] // shrink)
        self.order = order
        self.x = self.x[order]  # node i of every layer is vector order[i]
        self.hints = hints[order] if hints is not None else np.empty((n, 0), np.int64)
        self.before = np.full(self.hints.shape, -1, np.int64)
        for j in range(self.hints.shape[1]):
            at = np.argsort(self.hints[:, j], kind="stable")
            same = np.flatnonzero(self.hints[at[1:], j] == self.hints[at[:-1], j])
            self.before[at[same + 1], j] = at[same]
        self.layers: list[np.ndarray] = []
        self.near = np.full((n, keep), -1, np.int64)
        self.near_sim = np.full((n, keep), -2, np.float32)
        for size in reversed(sizes):
            self.layers.append(self._layer(size, self._leaves(rng, leaf) if size == n else None))
        for _ in range(1, trees if n > leaf else 0):
            for block in self._leaves(rng, leaf):
                ids, sims = self._among(block)
                self._merge(block, ids, sims)

    def _leaves(self, rng: np.random.Generator, leaf: int) -> list[np.ndarray]:
        """All nodes in groups of at most ``leaf``, by halving along the line through two random nodes."""
        out, todo = [], [np.arange(len(self.x))]
        while todo:
            ids = todo.pop()
            if len(ids) <= leaf:
                out.append(ids)
                continue
            a, b = self.x[ids[rng.integers(len(ids), size=2)]]
            along = self.x[ids] @ (a - b) if (a != b).any() else rng.random(len(ids))
            half = len(ids) // 2
            part = np.argpartition(along, half)
            todo += [ids[part[:half]], ids[part[half:]]]
        return out

    def _among(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best other nodes of the block for each of its nodes, and their similarities."""
        q = self.x[block]
        own = q @ q.T
        np.fill_diagonal(own, -2)
        k = min(self.keep, len(block) - 1)
        if k < 1:
            return np.empty((len(block), 0), np.int64), np.empty((len(block), 0), np.float32)
        if len(block) < 8 * k:
            part = np.argpartition(-own, k - 1, axis=1)[:, :k]
            return block[part], np.take_along_axis(own, part, 1)
        # the k-th largest maximum of a part of the row is at most the k-th largest of the row
        parts = len(block) // 4
        tops = own[:, : 4 * parts].reshape(len(block), 4, parts).max(axis=1)
        at = np.flatnonzero(own >= np.partition(tops, parts - k, axis=1)[:, parts - k, None])
        r = at // len(block)
        size = np.bincount(r, minlength=len(block))
        width = int(size.max())
        place = np.arange(len(at)) + np.repeat(np.arange(len(block)) * width - np.cumsum(size) + size, size)
        far, ids = np.full(len(block) * width, 3, np.float32), np.zeros(len(block) * width, np.int64)
        far[place], ids[place] = -own.reshape(-1).take(at), at - r * len(block)
        part = np.argpartition(far.reshape(len(block), width), k - 1, axis=1)[:, :k] + np.arange(len(block))[:, None] * width
        return block.take(ids.take(part)), -far.take(part)

    def _merge(self, block: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Takes over into ``near`` what is better than the nodes met so far."""
        ids, sims = np.concatenate([self.near[block], ids], 1), np.concatenate([self.near_sim[block], sims], 1)
        order = np.argsort(ids, axis=1, kind="stable")  # a node met again counts once
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
        top = np.argpartition(-sims, self.keep - 1, axis=1)[:, : self.keep]
        self.near[block], self.near_sim[block] = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)

    def _enter(self, q: np.ndarray, upto: int) -> np.ndarray:
        """Entry nodes from the layers above ``upto``."""
        if not upto:
            return np.zeros((len(q), 1), np.int64)
        n = len(self.layers[0]) - 1
        ids = np.argpartition(-(q @ self.x[:n].T), min(4, n) - 1, axis=1)[:, :4]
        for layer in self.layers[1:upto]:
            ids, _ = self._beam(q, ids, layer, 8)
            ids = ids[:, :4]
        return ids

    def _layer(self, n: int, blocks: list[np.ndarray] | None) -> np.ndarray:
        """Links of the first ``n`` nodes; ``blocks`` says in which order the nodes of the lowest layer come."""
        level, last = len(self.layers), blocks is not None
        links = np.full((n + 1, self.degree), -1, np.int64)
        sims = np.full((n, self.degree), -2, np.float32)
        inside = np.zeros(n, bool)
        upper = len(self.layers[-1]) - 1 if self.layers else 0
        if last and upper:  # the nodes of the layers above come first, so paths lead on from them
            blocks = [np.arange(s, min(s + 512, upper)) for s in range(0, upper, 512)] + blocks
        elif not last:
            blocks = [np.arange(0, min(n, 256)), *(np.arange(s, min(s + 512, n)) for s in range(256, n, 512))]
        for block in blocks:
            q = self.x[block]
            cand, cs = self._among(block)
            fresh = ~inside[block]
            old, os_ = np.empty((len(block), 0), np.int64), np.empty((len(block), 0), np.float32)
            if inside.any():
                hint = self.before[block]
                hint = np.where((hint >= 0) & inside[np.maximum(hint, 0)], hint, -1)
                old, os_ = self._beam(q, np.concatenate([self._enter(q, level), hint], 1), links, self.ef)
                os_[old == block[:, None]] = -2
                old[os_ <= -2] = -1
            if last:
                self._merge(block, np.concatenate([cand, old], 1), np.concatenate([cs, os_], 1))
                self._back(self.near, self.near_sim, old, os_, block)
            inside[block] = True
            block, cand, cs, old, os_ = block[fresh], cand[fresh], cs[fresh], old[fresh], os_[fresh]
            if not len(block):
                continue
            cand, cs = np.concatenate([cand, old], 1), np.concatenate([cs, os_], 1)
            rank = np.argsort(-cs, axis=1, kind="stable")
            cand, cs = np.take_along_axis(cand, rank, 1), np.take_along_axis(cs, rank, 1)
            pick = self._diverse(cand, cs)
            links[block, : pick.shape[1]] = np.where(pick >= 0, np.take_along_axis(cand, np.maximum(pick, 0), 1), -1)
            sims[block, : pick.shape[1]] = np.where(pick >= 0, np.take_along_axis(cs, np.maximum(pick, 0), 1), -2)
            fwd, fs = links[block], sims[block]
            new = np.zeros(n + 1, bool)
            new[block] = True
            self._back(links, sims, np.where(new[fwd], -1, fwd), fs, block)
        return links

    @staticmethod
    def _back(ids: np.ndarray, sims: np.ndarray, to: np.ndarray, s: np.ndarray, block: np.ndarray) -> None:
        """Offers each block node to the nodes it found; they keep it in place of their farthest."""
        src = np.repeat(block, to.shape[1])
        dst, val = to.ravel(), s.ravel()
        good = dst >= 0
        src, dst, val = src[good], dst[good], val[good]
        good = val > sims.take(dst, 0).min(axis=1)
        src, dst, val = src[good], dst[good], val[good]
        good = ~(ids.take(dst, 0) == src[:, None]).any(axis=1)
        src, dst, val = src[good], dst[good], val[good]
        order = np.lexsort((-val, dst))
        src, dst, val = src[order], dst[order], val[order]
        while len(dst):  # one offer per node and round, best first
            first = np.r_[True, dst[1:] != dst[:-1]]
            d, v = dst[first], val[first]
            slot = sims[d].argmin(axis=1)
            better = v > sims[d, slot]
            ids[d[better], slot[better]] = src[first][better]
            sims[d[better], slot[better]] = v[better]
            src, dst, val = src[~first], dst[~first], val[~first]

    def _diverse(self, cand: np.ndarray, cs: np.ndarray) -> np.ndarray:
        """Columns of ``cand`` to link: near ones no linked one is nearer to, then the nearest of the rest."""
        width = min(cand.shape[1], self.degree + 8)
        c, s = cand[:, :width], cs[:, :width]
        v = self.x.take(np.maximum(c, 0), 0)
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(c.shape, bool)
        for j in range(width):
            hidden = ((between[:, j, :j] > s[:, j : j + 1]) & taken[:, :j]).any(axis=1) if j else np.zeros(len(c), bool)
            taken[:, j] = ~hidden & (c[:, j] >= 0) & (s[:, j] > -1.5)
        # taken first (in order), then the others by nearness
        rank = np.argsort(np.where(taken, 0, 1) * width + np.arange(width), axis=1)[:, : self.degree]
        return np.where(np.take_along_axis((c >= 0) & (s > -1.5), rank, 1), rank, -1)

    def _beam(self, q: np.ndarray, enter: np.ndarray, links: np.ndarray, ef: int, wide: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes of a layer for every query, best first (-1 and -2 where fewer)."""
        b, n = len(q), len(links) - 1  # the last row of links stands for no node
        x = self.x
        seen = np.zeros((b, n + 1), np.uint8)  # of every query: no node, then the nodes
        seen[:, 0] = 1
        flat = seen.reshape(-1)
        rows = np.arange(b)[:, None]
        ids = np.full((b, ef), -1, np.int64)
        far = np.full((b, ef), 2, np.float32)  # similarities, negative
        done = np.ones((b, ef), bool)
        e = np.minimum(enter, n - 1)[:, :ef]
        w = e.shape[1]
        ids[:, :w] = e
        far[:, :w] = -np.einsum("bkd,bd->bk", x[e], q)
        done[:, :w] = False
        dup = e < 0
        for j in range(1, w):
            dup[:, j] |= (e[:, :j] == e[:, j : j + 1]).any(axis=1)
        far[:, :w][dup], done[:, :w][dup], ids[:, :w][dup] = 2, True, -1
        seen[rows, e + 1] = 1
        out_i, out_f = ids, far
        live, at_row = np.arange(b), np.arange(b) * (n + 1) + 1  # the rows of ids, far and done are those of live
        while len(live):
            open_ = np.where(done, np.float32(3), far)
            best = np.argpartition(open_, min(wide, ef - 1), axis=1)[:, :wide] + np.arange(len(live))[:, None] * ef
            can = open_.take(best) < 3
            going = can.any(axis=1)
            if not going.all():  # queries that are over leave
                over = ~going
                out_i[live[over]], out_f[live[over]] = ids[over], far[over]
                live, at_row, ids, far, done, can = live[going], at_row[going], ids[going], far[going], done[going], can[going]
                if not len(live):
                    break
                best = best[going] % ef + np.arange(len(live))[:, None] * ef
            node = np.where(can, ids.take(best), -1)
            done.reshape(-1)[best] = True
            nb = links[node].reshape(len(live), -1)
            at = (nb + at_row[:, None]).ravel()
            new = np.flatnonzero(flat.take(at) == 0)
            # a node met twice in this step counts once: the mark of its last place stays
            at = at[new]
            r, c = np.divmod(new, nb.shape[1])
            c = (c + 1).astype(np.uint8)
            flat[at] = c
            one = flat.take(at) == c
            r, j = r[one], nb.take(new[one])
            s = -np.einsum("ij,ij->i", x.take(j, 0), q.take(live[r], 0))
            good = s < far.max(axis=1)[r]
            r, j, s = r[good], j[good], s[good]
            if not len(r):
                continue
            # only queries that met something nearer take it over
            size = np.bincount(r)
            hit = np.flatnonzero(size)
            size = size[hit]
            width = ef + int(size.max())
            place = np.repeat(np.arange(len(hit)) * width + ef - np.cumsum(size) + size, size) + np.arange(len(r))
            all_f, all_i, all_d = np.full((len(hit), width), 2, np.float32), np.full((len(hit), width), -1, np.int64), np.ones((len(hit), width), bool)
            all_f[:, :ef], all_i[:, :ef], all_d[:, :ef] = far[hit], ids[hit], done[hit]
            all_f.reshape(-1)[place], all_i.reshape(-1)[place], all_d.reshape(-1)[place] = s, j, False
            top = np.argpartition(all_f, ef - 1, axis=1)[:, :ef] + np.arange(len(hit))[:, None] * width
            far[hit], ids[hit], done[hit] = all_f.take(top), all_i.take(top), all_d.take(top)
        rank = np.argsort(out_f, axis=1)
        return np.take_along_axis(out_i, rank, 1), -np.take_along_axis(out_f, rank, 1)

    def search(self, q: np.ndarray, k: int, ef: int, hints: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest vectors of each query found with a beam of ``ef``: (index, similarity)."""
        out_i, out_s = [], []
        last = np.full((len(q), 0 if hints is None else hints.shape[1]), -1, np.int64)
        for j in range(last.shape[1]):
            at = np.argsort(self.hints[:, j], kind="stable")
            pos = np.searchsorted(self.hints[at, j], hints[:, j], "right") - 1
            ok = (pos >= 0) & (self.hints[at[np.maximum(pos, 0)], j] == hints[:, j])
            last[ok, j] = at[pos[ok]]
        for s in range(0, len(q), 512):
            part = np.ascontiguousarray(q[s : s + 512], np.float32)
            ids, sims = self._beam(part, np.concatenate([self._enter(part, len(self.layers) - 1), last[s : s + 512]], 1), self.layers[-1], max(ef, k))
            out_i.append(np.where(ids[:, :k] >= 0, self.order[np.maximum(ids[:, :k], 0)], -1))
            out_s.append(sims[:, :k])
        return (np.concatenate(out_i), np.concatenate(out_s)) if out_i else (np.empty((0, k), np.int64), np.empty((0, k), np.float32))

    def own(self) -> np.ndarray:
        """For every vector the best others met while building, unordered (-1 for none)."""
        out = np.full(self.near.shape, -1, np.int64)
        out[self.order] = np.where((self.near >= 0) & (self.near_sim > -1.5), self.order[np.maximum(self.near, 0)], -1)
        return out
