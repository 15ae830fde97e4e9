"""Hierarchical navigable small-world graphs over unit vectors, built and searched for many vectors in step.

The graph holds the leaders of balls: a vector within half the link angle of a leader joins its ball, as all members of
such a ball are linked with each other. A family of near copies is then one node, however many members it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

NEIGHBOURS = 16  # links of a node on the upper levels; twice as many on the lowest
BUILD_BEAM, UPPER_BEAM, BATCH, CANDIDATES = 48, 8, 256, 64
TOP = 8  # highest level


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` most similar nodes that a best-first walk from ``start`` (queries, s) meets: ids (-1: none) and similarities, most similar first."""
    n_queries = len(q)
    owner = np.full((n_queries, len(x)), -1, np.int32)
    width = max(width, start.shape[1])
    at_once = min(at_once, width)
    ids = np.full((n_queries, width), -1, np.int32)
    sims = np.full((n_queries, width), -3, np.float32)
    ids[:, : start.shape[1]] = start
    sims[:, : start.shape[1]] = np.where(start >= 0, np.einsum("bsd,bd->bs", x[start], q), -3)
    opened = ids >= 0
    r, c = np.nonzero(opened)
    owner[r, ids[r, c]] = 0
    active, stamp = np.arange(n_queries), 1
    while len(active):
        ranked = np.where(opened[active], sims[active], -4)
        pick = np.argpartition(-ranked, at_once - 1, axis=1)[:, :at_once]
        chosen = np.take_along_axis(opened[active], pick, 1)
        going = chosen.any(axis=1)
        active, pick, chosen = active[going], pick[going], chosen[going]
        if not len(active):
            break
        nodes = ids[active[:, None], pick]
        opened[active[:, None], pick] = False
        near = np.where(chosen[:, :, None], links[nodes], -1).reshape(len(active), -1)
        r, c = np.nonzero(near >= 0)
        node = near[r, c]
        fresh = owner[active[r], node] < 0
        r, node = r[fresh], node[fresh]
        mark = np.arange(stamp, stamp + len(r), dtype=np.int32)
        stamp += len(r)
        owner[active[r], node] = mark
        once = owner[active[r], node] == mark
        r, node = r[once], node[once]
        if not len(r):
            continue
        sim = np.einsum("ij,ij->i", x[node], q[active[r]])
        count = np.bincount(r, minlength=len(active))
        place = np.arange(len(r)) - (np.cumsum(count) - count)[r]
        more_ids = np.full((len(active), count.max()), -1, np.int32)
        more_sims = np.full(more_ids.shape, -3, np.float32)
        more_ids[r, place], more_sims[r, place] = node, sim
        all_sims = np.concatenate([sims[active], more_sims], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], more_ids], axis=1), keep, 1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], more_ids >= 0], axis=1), keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` candidates a row (-1: none): first those nearer to the row than to any taken before, then the most similar of the rest."""
    out = np.full((len(ids), m), -1, np.int32)
    for a in range(0, len(ids), 512):
        i, s = ids[a : a + 512], np.where(ids[a : a + 512] >= 0, sims[a : a + 512], -3)
        order = np.argsort(-s, axis=1, kind="stable")[:, : max(m, CANDIDATES)]
        i, s = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
        v = x[i]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(i.shape, bool)
        for c in range(i.shape[1]):
            closest = np.where(taken, between[:, c], -2).max(axis=1)
            taken[:, c] = (i[:, c] >= 0) & (closest < s[:, c]) & (taken.sum(axis=1) < m)
        rank = np.where(i < 0, 3 * i.shape[1], np.where(taken, 0, i.shape[1])) + np.arange(i.shape[1])
        first = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out[a : a + 512, : first.shape[1]] = np.take_along_axis(i, first, 1)
    return out


@dataclass
class Graph:
    """Leaders ``x`` (float32), their level, and ``links[level]`` (nodes, neighbours), -1 for none."""

    x: np.ndarray
    level: np.ndarray
    links: list[np.ndarray]
    size: int = 0
    entry: int = -1
    beams: dict = field(default_factory=dict)

    @classmethod
    def empty(cls, n: int, d: int) -> Graph:
        links = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(TOP + 1)]
        return cls(np.zeros((n, d), np.float32), np.zeros(n, np.int32), links)

    def search(self, q: np.ndarray, width: int, per_level: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam of the lowest level for every query, from the entry node downwards."""
        start = np.full((len(q), 1), self.entry, np.int32)
        for k in range(int(self.level[self.entry]), 0, -1):
            ids, sims = beam(self.x[: self.size], self.links[k], q, start, UPPER_BEAM)
            if per_level is not None:
                per_level[k] = ids, sims
            start = ids[:, :UPPER_BEAM]
            start = np.where(start >= 0, start, -1)
        return beam(self.x[: self.size], self.links[0], q, start, width)

    def insert(self, q: np.ndarray, level: np.ndarray, per_level: dict) -> None:
        """New nodes, given the beams of their search on each level."""
        first, k = self.size, len(q)
        new = np.arange(first, first + k, dtype=np.int32)
        self.x[new], self.level[new] = q, level
        self.size += k
        between = (q @ q.T).astype(np.float32)
        np.fill_diagonal(between, -3)
        for at in range(int(level.max()) + 1):
            own = np.flatnonzero(level >= at)
            peers = between[np.ix_(own, own)]
            peer_ids = np.broadcast_to(new[own], peers.shape)
            peer_ids = np.where(peers > -3, peer_ids, -1)
            if at in per_level:
                ids, sims = per_level[at]
                peer_ids, peers = np.concatenate([ids[own], peer_ids], axis=1), np.concatenate([sims[own], peers], axis=1)
            links = self.links[at]
            m = NEIGHBOURS
            links[new[own], :m] = choose(self.x, peer_ids, peers, m)
            self._answer(links, new[own], m)
        top = int(np.argmax(level))
        if self.entry < 0 or level[top] > self.level[self.entry]:
            self.entry = int(new[top])

    def _answer(self, links: np.ndarray, new: np.ndarray, m: int) -> None:
        """Links back to the new nodes; a node with too many chooses anew among the old and the new ones."""
        r, c = np.nonzero(links[new, :m] >= 0)
        to, who = links[new[r], c], new[r]
        order = np.argsort(to, kind="stable")
        to, who = to[order], who[order]
        nodes, at, count = np.unique(to, return_index=True, return_counts=True)
        if not len(nodes):
            return
        slot = np.repeat(np.arange(len(nodes)), count)
        come = np.full((len(nodes), count.max()), -1, np.int32)
        come[slot, np.arange(len(to)) - np.repeat(at, count)] = who
        come = np.where((come[:, :, None] == links[nodes][:, None, :]).any(axis=2), -1, come)
        both = np.concatenate([links[nodes], come], axis=1)
        for a in range(0, len(nodes), 512):
            i = both[a : a + 512]
            sims = np.where(i >= 0, np.einsum("acd,ad->ac", self.x[i], self.x[nodes[a : a + 512]]), -3)
            full = (i >= 0).sum(axis=1) > links.shape[1]
            packed = np.take_along_axis(i, np.argsort(i < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
            if full.any():
                packed[full] = choose(self.x, i[full], sims[full], links.shape[1])
            links[nodes[a : a + 512]] = packed


def build(x: np.ndarray, draw: np.ndarray, join: float) -> tuple[Graph, np.ndarray, np.ndarray]:
    """Graph, the row of each node, and the ball (a node) of each row of ``x``, unit vectors.

    A row whose cosine to a leader is ``join`` or more belongs to its ball; ``draw`` (0 to 1) gives a node its level.
    """
    n = len(x)
    graph = Graph.empty(n, x.shape[1])
    ball, row_of = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    levels = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)), TOP).astype(np.int32)
    at = 0
    while at < n:
        rows = np.arange(at, min(n, at + min(BATCH, max(1, graph.size))))
        at = int(rows[-1]) + 1
        q, per_level = x[rows].astype(np.float32), {}
        left = np.ones(len(rows), bool)
        if graph.size:
            per_level[0] = graph.search(q, BUILD_BEAM, per_level)
            best = per_level[0][0][:, 0]
            near = (np.einsum("ij,ij->i", x[rows], x[row_of[best]]) >= join) & (best >= 0)
            ball[rows[near]] = best[near]
            left = ~near
        rest = np.flatnonzero(left)
        between = x[rows[rest]] @ x[rows[rest]].T
        heads: list[int] = []
        for i in range(len(rest)):
            close = between[i, heads] if heads else np.zeros(0)
            if len(close) and close.max() >= join:
                ball[rows[rest[i]]] = graph.size + int(close.argmax())
            else:
                ball[rows[rest[i]]] = graph.size + len(heads)
                heads.append(i)
        if heads:
            own = rest[heads]
            row_of[graph.size : graph.size + len(own)] = rows[own]
            graph.insert(q[own], levels[rows[own]], {k: (ids[own], sims[own]) for k, (ids, sims) in per_level.items()})
    return graph, row_of[: graph.size], ball
