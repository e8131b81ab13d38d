"""Small single-threaded model of the mesh operators, for comparison in tests.

Works directly from the definitions with dictionaries; written for clarity and
only for rasters of a few hundred cells.
"""

from __future__ import annotations

import math


class Model:
    def __init__(self, grid, inside=None, perm_v=None, perm_e=None, edge_region=None):
        """grid[y][x]; default region is the whole raster with permeable left and right sides."""
        self.hgt = {(x, y): v for y, row in enumerate(grid) for x, v in enumerate(row)}
        self.w, self.hh = len(grid[0]), len(grid)
        w, hh = self.w, self.hh
        if inside is None:
            inside = {(x, y) for x in range(w - 1) for y in range(hh - 1)}
        self.faces = inside
        self.edges = set()
        for x, y in inside:
            self.edges |= {((x, y), (x + 1, y)), ((x, y + 1), (x + 1, y + 1)),
                           ((x, y), (x, y + 1)), ((x + 1, y), (x + 1, y + 1))}
        self.verts = {v for e in self.edges for v in e}
        if perm_e is None:
            perm_e = {e for e in self.edges if e[0][0] == e[1][0] and e[0][0] in (0, w - 1)}
            perm_v = {v for v in self.verts if v[0] in (0, w - 1)}
            edge_region = {e: (0 if e[0][1] == 0 else 1) for e in self.edges
                           if e[0][1] == e[1][1] and e[0][1] in (0, hh - 1)}
        self.perm_e, self.perm_v, self.edge_region = perm_e, perm_v, edge_region
        self._pair()

    def p(self, v):
        return (self.hgt[v], v[0], v[1])

    def corners(self, f):
        x, y = f
        return [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]

    def sides(self, f):
        c = self.corners(f)
        return [tuple(sorted((c[i], c[(i + 1) % 4]))) for i in range(4)]

    def across(self, f, side):
        x, y = f
        return [(x, y - 1), (x + 1, y), (x, y + 1), (x - 1, y)][side]

    def nbrs(self, v):
        x, y = v
        return [u for u in ((x + 1, y), (x, y - 1), (x - 1, y), (x, y + 1))
                if tuple(sorted((u, v))) in self.edges]

    def _pair(self):
        self.vpair = {}
        for v in self.verts - self.perm_v:
            low = min(self.nbrs(v), key=self.p)
            if self.p(low) < self.p(v):
                self.vpair[v] = low
        vertex_edges = {tuple(sorted(i)) for i in self.vpair.items()}
        self.fpair = {}
        used = set()
        ranked = {f: sorted(range(4), key=lambda s: sorted(map(self.p, self.sides(f)[s]), reverse=True), reverse=True)
                  for f in self.faces}
        self.ranked = ranked

        def far(f, e):
            return max(self.p(c) for c in self.corners(f) if c not in e)

        for rank in (0, 1):
            for f in sorted(self.faces):
                if f in self.fpair:
                    continue
                s = ranked[f][rank]
                e = self.sides(f)[s]
                if e in self.perm_e or e in used or (rank == 1 and e in vertex_edges):
                    continue
                g = self.across(f, s)
                if g not in self.faces or far(f, e) < far(g, e):
                    self.fpair[f] = s
                    used.add(e)
        self.minima = {v for v in self.verts if v not in self.vpair and v not in self.perm_v}
        self.saddles = {e for e in self.edges if e not in vertex_edges and e not in used and e not in self.perm_e}
        self.maxima = {f for f in self.faces if f not in self.fpair}

    # --- flows
    def sink(self, v):
        n = 0
        while v in self.vpair:
            v, n = self.vpair[v], n + 1
        return (self.vid(v) if v in self.minima else -1), n

    def vid(self, v):
        return v[1] * self.w + v[0]

    def cell(self, f, e=None):
        """Cell id of a face; an outside face counts as -1-region of edge e."""
        while f in self.faces:
            if f not in self.fpair:
                return self.vid(f)
            s = self.fpair[f]
            e, f = self.sides(f)[s], self.across(f, s)
        return -1 - self.edge_region[e]

    def saddle_rows(self):
        """(saddle_id, key, cell_a, cell_b, sink_a, sink_b)"""
        rows = []
        for e in self.saddles:
            (x, y), (x2, y2) = e
            hid = 4 * self.vid(e[0]) + (0 if y == y2 else 3)
            fa, fb = ((x, y), (x, y - 1)) if y == y2 else ((x - 1, y), (x, y))
            key = (max(self.hgt[e[0]], self.hgt[e[1]]), (x + x2) / 2, (y + y2) / 2)
            rows.append((hid, key, self.cell(fa, e), self.cell(fb, e), self.sink(e[0])[0], self.sink(e[1])[0]))
        return rows

    def significance(self):
        """Sequential merge from high to low: (delta per saddle, tree parent map, volume per node)."""
        corner = {}
        for f in self.faces:
            c = self.cell(f)
            corner.setdefault(c, []).extend(self.hgt[v] for v in self.corners(f))
        comp = {}
        node_of = {}
        vol = lambda hs, h: sum(0.25 * max(0.0, v - h) for v in hs)
        delta, parent, volume, splits = {}, {}, {}, {}

        def find(c):
            comp.setdefault(c, c)
            while comp[c] != c:
                c = comp[c]
            return c

        members = {}
        for hid, key, a, b, *_ in sorted(self.saddle_rows(), key=lambda r: r[1], reverse=True):
            side = []
            for c in (find(a), find(b)):
                members.setdefault(c, list(corner.get(c, [])) if c >= 0 else None)
                side.append((c, math.inf if members[c] is None else vol(members[c], key[0])))
            (ca, va), (cb, vb) = side
            delta[hid] = min(va, vb)
            splits[hid] = ca != cb
            if ca != cb:
                for c in (ca, cb):
                    parent[node_of.get(c, ("cell", c))] = ("saddle", hid)
                comp[cb] = ca
                members[ca] = None if members[ca] is None or members[cb] is None else members[ca] + members[cb]
                node_of[ca] = ("saddle", hid)
                volume[hid] = va + vb
        return delta, splits, parent, volume

    def clean(self, delta):
        """Lower the largest delta at every minimum to the second largest, until stable."""
        links = {hid: [sa, sb] for hid, _, _, _, sa, sb in self.saddle_rows()}
        delta = dict(delta)
        changed = True
        while changed:
            changed = False
            at = {}
            for hid, ends in links.items():
                for s in ends:
                    if s >= 0:
                        at.setdefault(s, []).append(hid)
            for s, hids in at.items():
                hids = sorted(hids, key=lambda i: -delta[i])
                cap = delta[hids[1]] if len(hids) > 1 else 0.0
                if delta[hids[0]] > cap:
                    delta[hids[0]] = cap
                    changed = True
        return delta
