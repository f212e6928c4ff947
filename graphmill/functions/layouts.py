"""Layouts of one graph: (n, us, vs, seed) -> places of nodes and bends of edges (by edge number).

A layout that a graph cannot have, or that needs a program which isn't here, raises NotApplicable. All are pure
functions of the graph and the seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from . import kernels

Bends = dict[int, np.ndarray]
LAYOUTS: dict[str, Callable[..., tuple[np.ndarray, Bends]]] = {}
#: Layouts whose result depends on the seed.
SEEDED = {"random", "fruchterman-reingold", "forceatlas2", "stress-majorization"}
#: Layouts for which a manifest flag tells in advance whether they apply.
NEEDS = {"planar": "is_planar", "radial-tree": "is_tree"}
#: Known layouts that need programs which aren't here.
ELSEWHERE = ("FMMM", "planarization-ortho", "HOLA", "dot-ortho", "sfdp", "drgraph")


class NotApplicable(Exception):
    """The layout isn't defined for this graph, or not available."""


def register(name: str) -> Callable:
    def add(f: Callable[..., tuple[np.ndarray, Bends]]) -> Callable:
        if name in LAYOUTS:
            raise ValueError(f"layout {name} exists")
        LAYOUTS[name] = f
        return f

    return add


def lay_out(name: str, n: int, us: np.ndarray, vs: np.ndarray, seed: int = 0, **more: object) -> tuple[np.ndarray, Bends]:
    if name not in LAYOUTS:
        raise NotApplicable(name)
    if n == 0:
        return np.zeros((0, 2)), {}
    if n == 1:
        return np.zeros((1, 2)), {}
    return LAYOUTS[name](n, us, vs, seed=seed, **more)


def standardised(xy: np.ndarray, bends: Bends, us: np.ndarray) -> tuple[np.ndarray, Bends]:
    """Centre at 0, diagonal 1000; bends run from us[i] on."""
    low, high = xy.min(axis=0), xy.max(axis=0)
    diag = float(np.hypot(*(high - low)))
    mid, k = (low + high) / 2, 1000 / diag if diag > 0 else 1.0
    out = {}
    for i, b in bends.items():
        b = (np.asarray(b, float) - mid) * k
        s = (xy[us[i]] - mid) * k
        out[i] = b[::-1] if len(b) > 1 and np.hypot(*(b[-1] - s)) < np.hypot(*(b[0] - s)) else b
    return (xy - mid) * k, out


@register("circular")
def circular(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    a = 2 * np.pi * np.arange(n) / n
    return np.column_stack((np.cos(a), np.sin(a))), {}


@register("random")
def random(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """Places from the digits of md5 of seed and node, as drawings.random has them."""
    start = hashlib.md5(f"{seed}|".encode())
    digests = b""
    for i in range(n):
        one = start.copy()
        one.update(b"%d" % i)
        digests += one.digest()[:6]
    x = np.frombuffer(digests, np.uint8).reshape(n, 2, 3)
    return (x @ np.array([65536.0, 256.0, 1.0])) / 16.0**6, {}


def bfs_order(n: int, us: np.ndarray, vs: np.ndarray) -> list[int]:
    """Breadth first from the node of least (degree, number), neighbours by the same key; other components likewise."""
    by = np.argsort(np.bincount(np.concatenate((us, vs)), minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    near = kernels.neighbours(n, rank[us], rank[vs])  # by rank, so neighbours come in the order of the key
    seen, out = [False] * n, []
    for s in range(n):
        todo = [] if seen[s] else [s]
        seen[s] = True
        for x in todo:
            for y in near[x]:
                if not seen[y]:
                    seen[y] = True
                    todo.append(y)
        out += todo
    return by[out].tolist()


@register("arc-bfs")
def arc_bfs(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """Nodes on a line in breadth-first order, edges as half circles above it with eight bends."""
    x = np.empty(n)
    x[bfs_order(n, us, vs)] = np.arange(n)
    turn = np.pi * np.arange(1, 9) / 9
    bends = {}
    for i in range(len(us)):
        a, b = x[us[i]], x[vs[i]]
        bends[i] = np.column_stack(((a + b) / 2 - (b - a) / 2 * np.cos(turn), abs(b - a) / 2 * np.sin(turn)))
    return np.column_stack((x, np.zeros(n))), bends


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns whose first entry away from 0 is positive."""
    v = v.copy()
    for j in range(v.shape[1]):
        at = np.flatnonzero(np.abs(v[:, j]) > 1e-9)
        if len(at) and v[at[0], j] < 0:
            v[:, j] *= -1
    return v


@register("spectral")
def spectral(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """The Laplacian's eigenvectors of second and third least eigenvalue."""
    a = kernels.adjacency(n, us, vs).astype(float)
    v = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)[1][:, 1:3]
    return _signed(np.hstack((v, np.zeros((n, 2))))[:, :2]), {}


def _hops(n: int, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """Distances; between components one more than the greatest."""
    d = kernels.all_distances(n, us, vs).astype(float)
    return np.where(d < 0, d.max() + 1, d)


def _smacof(d: np.ndarray, xy: np.ndarray, rounds: int = 80, tol: float = 1e-4) -> np.ndarray:
    """Stress with weights d**-2 made less by majorisation, node 0 pinned, until a round gains less than tol of it."""
    n = len(d)
    w = np.where(d > 0, 1.0 / np.where(d > 0, d, 1) ** 2, 0.0)
    lap = np.diag(w.sum(axis=1)) - w
    i, j = np.triu_indices(n, 1)
    solve = np.linalg.inv(lap[1:, 1:])  # the same system in every round

    def gaps(p: np.ndarray) -> np.ndarray:
        ex, ey = p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1]
        return np.sqrt(ex * ex + ey * ey)

    wij, dij, gap = w[i, j], d[i, j], gaps(xy)
    old = float((wij * (gap[i, j] - dij) ** 2).sum())
    for _ in range(rounds):
        b = np.where(gap > 1e-12, w * d / np.where(gap > 1e-12, gap, 1), 0.0)
        rhs = (np.diag(b.sum(axis=1)) - b) @ xy - lap[:, :1] * xy[:1]
        xy = np.vstack((xy[:1], solve @ rhs[1:]))
        gap = gaps(xy)
        new = float((wij * (gap[i, j] - dij) ** 2).sum())
        if old - new < tol * max(old, 1e-300):
            break
        old = new
    return xy


@register("stress-majorization")
def stress_majorization(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    return _smacof(_hops(n, us, vs), np.random.default_rng(seed).random((n, 2)) * np.sqrt(n)), {}


@register("kamada-kawai")
def kamada_kawai(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """The same energy from the circular layout on, to a finer end."""
    d = _hops(n, us, vs)
    return _smacof(d, circular(n, us, vs)[0] * d.max() / 2, 300, 1e-6), {}


@register("fruchterman-reingold")
def fruchterman_reingold(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """50 rounds of repulsion k^2 / d and attraction d^2 / k, with steps that shrink evenly."""
    a, xy = kernels.adjacency(n, us, vs), np.random.default_rng(seed).random((n, 2))
    k, step = 1 / np.sqrt(n), 0.1
    for r in range(50):
        e = xy[:, None] - xy[None]
        d = np.maximum(np.sqrt(e[..., 0] * e[..., 0] + e[..., 1] * e[..., 1]), 0.01)
        force = (e * (k * k / d**2 - a * d / k)[..., None]).sum(axis=1)
        size = np.maximum(np.hypot(*force.T), 0.01)
        xy = xy + force * (step * (1 - r / 50) / size)[:, None]
    return xy, {}


@register("forceatlas2")
def forceatlas2(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """100 rounds of linear attraction, repulsion by (degree + 1) products, weak gravity; each node's speed falls as it swings."""
    a, xy = kernels.adjacency(n, us, vs).astype(float), np.random.default_rng(seed).random((n, 2)) * 10
    mass, last = a.sum(axis=1) + 1, np.zeros((n, 2))
    for _ in range(100):
        e = xy[:, None] - xy[None]
        d2 = np.maximum((e**2).sum(axis=2), 1e-4)
        force = (e * (2.0 * mass[:, None] * mass[None] / d2 - a)[..., None]).sum(axis=1)
        out = np.maximum(np.hypot(*xy.T), 1e-9)
        force -= xy / out[:, None] * mass[:, None]
        swing = np.hypot(*(force - last).T)
        size = np.maximum(np.hypot(*force.T), 1e-9)
        speed = np.minimum(0.1 / (1 + np.sqrt(0.1 * swing)), 10 / size)
        xy, last = xy + force * speed[:, None], force
    return xy, {}


@register("pivot-mds")
def pivot_mds(n, us, vs, seed=0, pivots: int = 50):  # noqa: ANN001, ANN201
    """Classical scaling from the distances to pivots, each the node furthest from those before."""
    d = _hops(n, us, vs)
    chosen = [0]
    while len(chosen) < min(pivots, n):
        chosen.append(int(d[:, chosen].min(axis=1).argmax()))
    return scaled(d, chosen), {}


def scaled(d: np.ndarray, chosen: list[int]) -> np.ndarray:
    """Places by classical scaling from the distances to the chosen nodes."""
    c = d[:, chosen] ** 2
    c = -(c - c.mean(axis=0) - c.mean(axis=1)[:, None] + c.mean()) / 2
    val, vec = np.linalg.eigh(c.T @ c)
    return _signed(np.hstack((c @ vec[:, ::-1][:, :2], np.zeros((len(d), 2))))[:, :2])


@register("radial-tree")
def radial_tree(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """A tree around its centre: depth is the radius, a subtree gets an angle by its leaves."""
    if len(us) != n - 1 or kernels.n_components(n, us, vs) > 1:
        raise NotApplicable("not a tree")
    near, d = kernels.neighbours(n, us, vs), kernels.all_distances(n, us, vs)
    root = int(d.max(axis=1).argmin())
    order, up = [root], {root: -1}
    for x in order:
        for y in near[x]:
            if y != up[x]:
                up[y] = x
                order.append(y)
    leaves = [0] * n
    for x in reversed(order):
        leaves[x] = max(1, leaves[x])
        if up[x] >= 0:
            leaves[up[x]] += leaves[x]
    low, xy = {root: 0.0}, np.zeros((n, 2))
    for x in order:
        share = 2 * np.pi / leaves[root]
        a, r = low[x] + leaves[x] * share / 2, d[root, x]
        xy[x] = r * np.cos(a), r * np.sin(a)
        at = low[x]
        for y in near[x]:
            if y != up[x]:
                low[y] = at
                at += leaves[y] * share
    return xy, {}


@register("planar")
def planar(n, us, vs, seed=0):  # noqa: ANN001, ANN201
    """Straight edges without crossings: the graph is joined up to a biconnected one, every face gets a node of its own,
    and the triangulation's nodes are put at the mean of their neighbours inside a fixed triangle."""
    if not kernels.is_planar(n, us, vs):
        raise NotApplicable("not planar")
    edges = {(min(a, b), max(a, b)) for a, b in zip(us.tolist(), vs.tolist(), strict=True)}
    arrays = lambda: (np.array([e[0] for e in sorted(edges)], np.int64), np.array([e[1] for e in sorted(edges)], np.int64))
    while kernels.n_components(n, *arrays()) > 1:
        d = kernels.all_distances(n, *arrays())
        edges.add((0, int(np.flatnonzero(d[0] < 0)[0])))
    while n > 2 and len(parts := kernels.blocks(n, *arrays())) > 1:
        owner: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            for x in {x for e in part for x in e}:
                owner.setdefault(x, []).append(k)
        cut = min(x for x, ks in owner.items() if len(ks) > 1)
        a, b = (min(y for e in parts[k] if cut in e for y in e if y != cut) for k in owner[cut][:2])
        edges.add((min(a, b), max(a, b)))
    if n < 3:
        return np.array([[0.0, 0.0], [1.0, 0.0]])[:n], {}
    faces = kernels.faces_of(sorted(edges))
    total = n + len(faces)
    lap = np.zeros((total, total))
    for a, b in [*edges, *((x, n + k) for k, f in enumerate(faces) for x in f)]:
        lap[a, b] = lap[b, a] = -1
    lap[np.arange(total), np.arange(total)] = -lap.sum(axis=1)
    k = max(range(len(faces)), key=lambda i: len(faces[i]))
    outer = [n + k, faces[k][0], faces[k][1]]
    inner = [x for x in range(total) if x not in outer]
    xy = np.zeros((total, 2))
    xy[outer] = [[0, 1], [-np.sqrt(3) / 2, -0.5], [np.sqrt(3) / 2, -0.5]]
    xy[inner] = np.linalg.solve(lap[np.ix_(inner, inner)], -lap[np.ix_(inner, outer)] @ xy[outer])
    return xy[:n], {}


@register("sugiyama")
def sugiyama(n, us, vs, seed=0, rounds: int = 8):  # noqa: ANN001, ANN201
    """Layers by distance from a root; long edges pass through dummies; layers ordered by their neighbours' mean place."""
    order = bfs_order(n, us, vs)
    d = kernels.all_distances(n, us, vs)
    layer, shift = [0] * n, 0
    seen: set[int] = set()
    for s in order:
        if s not in seen:
            part = [x for x in range(n) if d[s, x] >= 0]
            for x in part:
                layer[x] = int(d[s, x])
            seen |= set(part)
    ways, size = {}, n
    for i in range(len(us)):
        a, b = us[i], vs[i]
        step = 1 if layer[b] > layer[a] else -1
        way = []
        for level in range(layer[a] + step, layer[b], step) if layer[a] != layer[b] else ():
            layer.append(level)
            way.append(size)
            size += 1
        ways[i] = [int(a), *way, int(b)]
    near: list[list[int]] = [[] for _ in range(size)]
    for way in ways.values():
        for p, q in zip(way, way[1:], strict=False):
            near[p].append(q)
            near[q].append(p)
    rank = {x: k for k, x in enumerate(order)} | {x: x for x in range(n, size)}
    rows = [sorted((x for x in range(size) if layer[x] == level), key=rank.get) for level in range(max(layer) + 1)]
    place = {x: float(i) for row in rows for i, x in enumerate(row)}
    for r in range(rounds):
        for level in range(len(rows)) if r % 2 == 0 else range(len(rows) - 1, -1, -1):
            other = level - 1 if r % 2 == 0 else level + 1
            mean = lambda x: float(np.mean([place[y] for y in near[x] if layer[y] == other] or [place[x]]))  # noqa: E731, B023
            rows[level].sort(key=lambda x: (mean(x), x))  # noqa: B023
            place |= {x: float(i) for i, x in enumerate(rows[level])}
    xy = np.array([[place[x] - (len(rows[layer[x]]) - 1) / 2, -layer[x]] for x in range(size)])
    return xy[:n], {i: xy[way[1:-1]] for i, way in ways.items() if len(way) > 2}


@register("curated")
def curated(n, us, vs, seed=0, xy=None):  # noqa: ANN001, ANN201
    """The places that came with the graph; every node needs one."""
    if xy is None or len(xy) != n or not np.isfinite(np.asarray(xy, float)).all():
        raise NotApplicable("no place for every node")
    return np.asarray(xy, float), {}


@register("baur-brandes")
def baur_brandes(n, us, vs, seed=0, rounds: int = 10):  # noqa: ANN001, ANN201
    """A circle whose order is grown from the node with most placed neighbours, at the end with fewer new crossings, and
    then sifted: each node goes where, among all places, its edges cross fewest."""
    near = kernels.neighbours(n, us, vs)
    order: list[int] = []
    left = set(range(n))
    while left:
        x = min(left, key=lambda v: (sum(y in left for y in near[v]), -sum(y not in left for y in near[v]), v))
        left.discard(x)
        cost = [sum(order.index(y) for y in near[x] if y in order), sum(len(order) - 1 - order.index(y) for y in near[x] if y in order)]
        order.insert(0 if cost[0] < cost[1] else len(order), x)

    us, vs = us[us != vs], vs[us != vs]

    def costs(rest: list[int], x: int) -> np.ndarray:
        """Crossings of x's edges by the place in rest where x is put: a chord that x leaves on one side is crossed by the
        edges to its other side."""
        at = np.empty(n, np.int64)
        at[rest] = np.arange(n - 1)
        own = np.zeros(n, np.int64)
        own[at[[y for y in near[x] if y != x]]] = 1
        before = np.concatenate(([0], np.cumsum(own)))
        others = (us != x) & (vs != x)
        p, q = np.minimum(at[us[others]], at[vs[others]]), np.maximum(at[us[others]], at[vs[others]])
        inside = before[q] - before[p + 1]
        turned = own.sum() - own[p] - own[q] - 2 * inside
        step = np.bincount(p + 1, turned, n + 1) - np.bincount(q + 1, turned, n + 1)
        return inside.sum() + np.cumsum(step)[:n].astype(np.int64)

    for _ in range(rounds):
        before = list(order)
        for x in list(order):
            rest = [y for y in order if y != x]
            i = int(costs(rest, x).argmin())
            order = [*rest[:i], x, *rest[i:]]
        if order == before:
            break
    xy = np.empty((n, 2))
    xy[order] = circular(n, us, vs)[0]
    return xy, {}
