"""Max-min messages on the trees of a weighted graph, by rake and compress.

Every edge carries, for each direction, a function ``F(m) = max(low, min(cap, m))`` of
the message that enters it; at a vertex the messages of its edges and its own core meet
as a maximum.  Such functions compose to functions of the same form, so

* a vertex of degree one hands its message on and goes (rake),
* the two edges at a vertex of degree two become one edge (compress).

A round does this for all such vertices at once, of neighbouring ones of degree two for
those of the highest priority, so the rounds are logarithmic even for one long chain.
Undoing the rounds in reverse order gives the messages in both directions of every edge.

Of a cycle the weakest edge is taken out: with all others of the cycle at least as
strong, its ends feed each other, and it acts as a core of both.
"""

from __future__ import annotations

import numpy as np

LEAST = 0.0  # no message


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mask of the edges of a maximum spanning forest; of equal edges the earlier is stronger."""
    order = np.argsort(-weight, kind="stable")
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    chosen, comp, live = np.zeros(len(a), bool), np.arange(n), np.flatnonzero(a != b)
    while len(live):
        best = np.full(n, len(a))
        ca, cb = comp[a[live]], comp[b[live]]
        np.minimum.at(best, ca, rank[live])
        np.minimum.at(best, cb, rank[live])
        hooks = np.flatnonzero(best < len(a))
        edge = order[best[hooks]]
        chosen[edge] = True
        up = np.arange(n)
        up[hooks] = np.where(comp[a[edge]] == hooks, comp[b[edge]], comp[a[edge]])
        twin = (up[up] == np.arange(n)) & (np.arange(n) < up)  # two that chose the same edge
        up[twin] = np.flatnonzero(twin)
        while True:
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
        comp = up[comp]
        live = live[comp[a[live]] != comp[b[live]]]
    return chosen


class TreeContraction:
    """Contracts a forest with cores at its vertices down to the ``kept`` vertices and what connects them."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, low_ab: np.ndarray, low_ba: np.ndarray, cap: np.ndarray,
                 core: np.ndarray, kept: np.ndarray):
        size = len(a) + n  # no more edges than vertices are made
        room = lambda x, kind: np.concatenate([x, np.zeros(n, kind)])
        self.n, self.kept = n, kept
        self.a, self.b = room(a, np.int64).astype(np.int64), room(b, np.int64).astype(np.int64)
        self.low_ab, self.low_ba, self.cap = (room(x, np.float64) for x in (low_ab, low_ba, cap))
        self.into_a, self.into_b = np.full(size, LEAST), np.full(size, LEAST)
        # the two largest messages met at every vertex, and the edge that the largest came by
        self.first, self.second, self.by = core.astype(np.float64), np.full(n, LEAST), np.full(n, -1)
        self.made, self.rounds, self.steps = len(a), 0, []

    def meet(self, vertex: np.ndarray, message: np.ndarray, edge: np.ndarray) -> None:
        """Messages that arrive at vertices by edges."""
        order = np.lexsort((-message, vertex))
        v, m = vertex[order], message[order]
        head = np.ones(len(v), bool)
        head[1:] = v[1:] != v[:-1]
        at = np.flatnonzero(head)
        runner_up = np.full(len(at), LEAST)
        two = np.append(at[1:], len(v)) - at > 1
        runner_up[two] = m[at[two] + 1]
        v, m, e = v[at], m[at], edge[order][at]
        leads = m > self.first[v]
        self.second[v] = np.where(leads, np.maximum(self.first[v], runner_up), np.maximum(self.second[v], m))
        self.first[v] = np.where(leads, m, self.first[v])
        self.by[v] = np.where(leads, e, self.by[v])

    def besides(self, vertex: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Largest message at vertices that did not come by the given edges."""
        return np.where(self.by[vertex] == edge, self.second[vertex], self.first[vertex])

    def _through(self, edge: np.ndarray, from_a: np.ndarray, message: np.ndarray) -> np.ndarray:
        return np.maximum(np.where(from_a, self.low_ab[edge], self.low_ba[edge]), np.minimum(self.cap[edge], message))

    def contract(self) -> np.ndarray:
        """Run all rounds; the edges that are left."""
        rng = np.random.default_rng(self.n)
        live = np.arange(self.made)
        while True:
            left = self._compress(self._rake(live), rng)
            if left is None:
                return live
            live, self.rounds = left, self.rounds + 1

    def _degrees(self, live: np.ndarray) -> np.ndarray:
        return np.bincount(self.a[live], minlength=self.n) + np.bincount(self.b[live], minlength=self.n)

    def _rake(self, live: np.ndarray) -> tuple[np.ndarray, bool]:
        loose = (self._degrees(live) == 1) & ~self.kept
        leaf_a, leaf_b = loose[self.a[live]], loose[self.b[live]]
        gone = leaf_a | leaf_b
        edge, from_a = live[gone], leaf_a[gone]
        if not len(edge):
            return live, False
        leaf = np.where(from_a, self.a[edge], self.b[edge])
        held = self.first[leaf].copy()
        self.steps.append(("rake", edge, from_a, held))
        self.meet(np.where(from_a, self.b[edge], self.a[edge]), self._through(edge, from_a, held), edge)
        return live[~gone], True

    def _compress(self, raked: tuple[np.ndarray, bool], rng: np.random.Generator) -> np.ndarray | None:
        live, changed = raked
        inner = (self._degrees(live) == 2) & ~self.kept
        if not inner.any():
            return live if changed else None
        # both edges of every inner vertex
        vertex, edge = np.concatenate([self.a[live], self.b[live]]), np.concatenate([live, live])
        at_a = np.arange(len(vertex)) < len(live)
        pick = inner[vertex]
        vertex, edge, at_a = vertex[pick], edge[pick], at_a[pick]
        order = np.argsort(vertex, kind="stable")
        vertex, edge, at_a = (x[order].reshape(-1, 2) for x in (vertex, edge, at_a))
        v = vertex[:, 0]
        ends = np.where(at_a, self.b[edge], self.a[edge])
        priority = np.zeros(self.n, np.int64)
        priority[v] = rng.permutation(len(v)) + 1  # others have none
        top = (priority[v][:, None] > priority[ends]).all(1)
        v, edge, at_a, ends = v[top], edge[top], at_a[top], ends[top]
        new = np.arange(self.made, self.made + len(v))
        self.made += len(v)
        held = self.first[v].copy()
        (x, z), (e, f), (e_at_a, f_at_a) = ends.T, edge.T, at_a.T
        self.a[new], self.b[new], self.cap[new] = x, z, np.minimum(self.cap[e], self.cap[f])
        self.low_ab[new] = self._through(f, f_at_a, np.maximum(held, np.where(e_at_a, self.low_ba[e], self.low_ab[e])))
        self.low_ba[new] = self._through(e, e_at_a, np.maximum(held, np.where(f_at_a, self.low_ba[f], self.low_ab[f])))
        self.steps.append(("compress", v, e, e_at_a, f, f_at_a, new, held))
        gone = np.zeros(self.made, bool)
        gone[e] = gone[f] = True
        return np.concatenate([live[~gone[live]], new])

    def expand(self) -> None:
        """Messages into both ends of every edge, once everything has been contracted."""
        for kind, *step in reversed(self.steps):
            if kind == "rake":
                edge, from_a, held = step
                back = self.besides(np.where(from_a, self.b[edge], self.a[edge]), edge)
                self.into_a[edge], self.into_b[edge] = np.where(from_a, held, back), np.where(from_a, back, held)
                self.meet(np.where(from_a, self.a[edge], self.b[edge]), self._through(edge, ~from_a, back), edge)
            else:
                v, e, e_at_a, f, f_at_a, new, held = step
                by_e = self._through(e, ~e_at_a, self.into_a[new])
                by_f = self._through(f, ~f_at_a, self.into_b[new])
                for edge, at_a, far, near in ((e, e_at_a, self.into_a[new], np.maximum(held, by_f)),
                                              (f, f_at_a, self.into_b[new], np.maximum(held, by_e))):
                    self.into_a[edge], self.into_b[edge] = np.where(at_a, near, far), np.where(at_a, far, near)
                self.meet(np.concatenate([v, v]), np.concatenate([by_e, by_f]), np.concatenate([e, f]))


class Messages:
    """Max-min messages of a graph, its weakest edges in cycles taken out first.

    ``contract`` leaves ``kept`` vertices and what connects them; ``settle`` gives the messages.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, low_ab: np.ndarray, low_ba: np.ndarray, cap: np.ndarray,
                 core: np.ndarray, kept: np.ndarray):
        self.n, self.a, self.b, self.low_ab, self.low_ba, self.cap = n, a, b, low_ab, low_ba, cap
        self.tree = spanning_forest(n, a, b, cap)
        t, c = np.flatnonzero(self.tree), np.flatnonzero(~self.tree)
        self.forest = TreeContraction(n, a[t], b[t], low_ab[t], low_ba[t], cap[t], core, kept)
        self.forest.meet(np.concatenate([a[c], b[c]]), np.concatenate([np.maximum(low_ba[c], cap[c]), np.maximum(low_ab[c], cap[c])]),
                         np.full(2 * len(c), -1))
        self.live = self.forest.contract()

    def skeleton(self) -> tuple[np.ndarray, ...]:
        """a, b, low_ab, low_ba, cap of the edges that are left."""
        f = self.forest
        return tuple(x[self.live] for x in (f.a, f.b, f.low_ab, f.low_ba, f.cap))

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Message into the a end and the b end of every edge; edges taken out of cycles get infinity at both."""
        self.forest.expand()
        out = np.full((2, len(self.a)), np.inf)
        n = int(self.tree.sum())
        out[0, self.tree], out[1, self.tree] = self.forest.into_a[:n], self.forest.into_b[:n]
        return out[0], out[1]
