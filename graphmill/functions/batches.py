"""Layouts and scores of many graphs of one size at once: the functions of layouts and scores, with a first axis for the graph.

One numpy call works on a chunk of graphs, where small graphs would spend most of their time on the call. Nodes are dense, as all
graphs of a chunk have as many; edges and their pairs lie one behind the other. Equal to single graphs up to rounding.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from . import kernels, layouts
from .scores import NAMES

#: Pairs of nodes that a chunk may have, so that its arrays stay in the processor's cache.
PAIRS = 1 << 15


class Chunk:
    """Connected or not, graphs of n nodes (3 or more), each with an edge and without loops; what all their drawings share."""

    def __init__(self, n: int, graphs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n, self.size, self.graphs = n, len(graphs), graphs
        self.m = np.array([len(us) for us, _ in graphs])
        self.us, self.vs = (np.concatenate([g[k] for g in graphs]) for k in (0, 1))
        self.of = np.repeat(np.arange(self.size), self.m)
        self.starts = np.cumsum(self.m) - self.m
        self.adjacency = np.zeros((self.size, n, n), bool)
        self.adjacency[self.of, self.us, self.vs] = self.adjacency[self.of, self.vs, self.us] = True
        self.deg = np.bincount(np.concatenate((self.of * n + self.us, self.of * n + self.vs)), minlength=self.size * n).reshape(self.size, n)
        self.hops = self._distances()
        self.i, self.j = np.triu_indices(n, 1)

    def _distances(self) -> np.ndarray:
        a = self.adjacency.astype(np.float32)
        seen = np.broadcast_to(np.eye(self.n, dtype=bool), a.shape).copy()
        out, front, hops = np.where(seen, 0, -1), seen, 0
        while front.any():
            hops += 1
            front = (front.astype(np.float32) @ a > 0) & ~seen
            seen |= front
            out[front] = hops
        return out

    @functools.cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The connected graphs; the hops between their pairs of nodes, and these in order."""
        joined = np.flatnonzero((self.hops >= 0).all(axis=(1, 2)))
        hops = self.hops[joined][:, self.i, self.j]
        return joined, hops, np.sort(hops, axis=1)

    def part(self, which: list[int]) -> Chunk:
        return Chunk(self.n, [self.graphs[i] for i in which])

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum over each graph's edges."""
        return np.bincount(self.of, x, self.size)

    def filled_hops(self) -> np.ndarray:
        d = self.hops.astype(float)
        return np.where(d < 0, d.max(axis=(1, 2), keepdims=True) + 1, d)


class _Pairs:
    """Pairs of n nodes, each once, beside matrices of all n x n."""

    def __init__(self, n: int) -> None:
        i, j = np.triu_indices(n, 1)
        self.n, self.i, self.j, self.at, self.back = n, i, j, i * n + j, np.full(n * n, len(i))
        self.back[i * n + j] = self.back[j * n + i] = np.arange(len(i))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.take(x.reshape(len(x), -1), self.at, axis=1)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """The symmetric matrices with 0 on the diagonal."""
        return np.take(np.concatenate((x, np.zeros((len(x), 1))), axis=1), self.back, axis=1).reshape(-1, self.n, self.n)

    def gaps(self, xy: np.ndarray) -> np.ndarray:
        ex, ey = (np.take(v, self.i, axis=1) - np.take(v, self.j, axis=1) for v in (xy[:, :, 0].copy(), xy[:, :, 1].copy()))
        return np.sqrt(ex * ex + ey * ey)


def _smacof(d: np.ndarray, xy: np.ndarray, rounds: int = 80, tol: float = 1e-4) -> np.ndarray:
    """layouts._smacof, to the last bit; graphs that have come to their end leave the chunk, a quarter of it at a time."""
    n, out, xy = d.shape[1], np.array(xy), np.ascontiguousarray(xy)
    on, pairs = np.arange(n), _Pairs(n)
    w = np.where(d > 0, 1.0 / np.where(d > 0, d, 1) ** 2, 0.0)
    lap = 0.0 - w
    lap[:, on, on] = w.sum(axis=2)
    solve, first, left = np.linalg.inv(lap[:, 1:, 1:]), lap[:, :, :1].copy(), np.arange(len(d))
    w, d = pairs.of(w), pairs.of(d)
    wd = w * d

    def energy(gap: np.ndarray) -> np.ndarray:
        e = gap - d
        e *= e
        e *= w
        return e.sum(axis=1)

    gap = pairs.gaps(xy)
    old, live = energy(gap), np.ones(len(d), bool)
    for _ in range(rounds):
        np.putmask(gap, gap <= 1e-12, np.inf)
        b = pairs.matrix(np.divide(wd, gap, out=gap))
        total = b.sum(axis=2)
        np.subtract(0.0, b, out=b)
        b[:, on, on] = total
        rhs = b @ xy - first * xy[:, :1]
        xy = np.concatenate((xy[:, :1], solve @ rhs[:, 1:]), axis=1)
        gap = pairs.gaps(xy)
        new = energy(gap)
        end = live & (old - new < tol * np.maximum(old, 1e-300))
        old = new
        if end.any():
            out[left[end]] = xy[end]
            live &= ~end
            if not live.any():
                return out
            if 4 * live.sum() <= 3 * len(live):
                left, xy, gap, old, w, d, wd, solve, first, live = (x[live] for x in (left, xy, gap, old, w, d, wd, solve, first, live))
    out[left[live]] = xy[live]
    return out


def _smacof_near(d: np.ndarray, xy: np.ndarray, rounds: int = 80, tol: float = 1e-4) -> np.ndarray:
    """_smacof to rounding, where starts are in general position, in half the time: differences of places and sums over pairs are
    products with one matrix for all graphs."""
    n, out = d.shape[1], np.array(xy)
    on, (i, j) = np.arange(n), np.triu_indices(n, 1)
    ends = np.zeros((n, len(i)))
    ends[i, np.arange(len(i))], ends[j, np.arange(len(i))] = 1, -1
    lap = -1.0 / np.where(d > 0, d, np.inf) ** 2
    lap[:, on, on] = -lap.sum(axis=2)
    solve, first = np.linalg.inv(lap[:, 1:, 1:]), lap[:, 1:, 0].copy()
    wd = 1 / d[:, i, j]
    w, at, left, live = wd * wd, xy.transpose(2, 0, 1).copy(), np.arange(len(d)), np.ones(len(d), bool)

    def gaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = (at.reshape(-1, n) @ ends).reshape(2, -1, len(i))
        square = e[0] * e[0]
        square += e[1] * e[1]
        gap = np.sqrt(square)
        return e, gap, len(i) + np.einsum("ij,ij->i", w, square) - 2 * np.einsum("ij,ij->i", wd, gap)

    e, gap, old = gaps()
    for _ in range(rounds):
        np.putmask(gap, gap <= 1e-12, np.inf)
        e *= np.divide(wd, gap, out=gap)
        rhs = (e.reshape(-1, len(i)) @ ends.T).reshape(2, -1, n)[:, :, 1:] - first * at[:, :, :1]
        at[:, :, 1:] = (solve @ rhs.transpose(1, 2, 0).copy()).transpose(2, 0, 1)
        e, gap, new = gaps()
        end = live & (old - new < tol * np.maximum(old, 1e-300))
        old = new
        if end.any():
            out[left[end]] = at[:, end].transpose(1, 2, 0)
            live &= ~end
            if not live.any():
                return out
            if 4 * live.sum() <= 3 * len(live):
                at, e = at[:, live], e[:, live]
                left, gap, old, w, wd, solve, first, live = (x[live] for x in (left, gap, old, w, wd, solve, first, live))
    out[left[live]] = at[:, live].transpose(1, 2, 0)
    return out


def _starts(c: Chunk, seeds: list[int]) -> np.ndarray:
    return np.array([np.random.default_rng(s).random((c.n, 2)) for s in seeds])


def stress_majorization(c: Chunk, seeds: list[int]) -> np.ndarray:
    return _smacof_near(c.filled_hops(), _starts(c, seeds) * np.sqrt(c.n))


def kamada_kawai(c: Chunk, seeds: list[int]) -> np.ndarray:
    d = c.filled_hops()
    return _smacof(d, circular(c, seeds) * d.max(axis=(1, 2))[:, None, None] / 2, 300, 1e-6)


def circular(c: Chunk, seeds: list[int]) -> np.ndarray:
    return np.broadcast_to(layouts.circular(c.n, None, None)[0], (c.size, c.n, 2))


def random(c: Chunk, seeds: list[int]) -> np.ndarray:
    return np.array([layouts.random(c.n, None, None, s)[0] for s in seeds])


def _to_all(v: np.ndarray) -> np.ndarray:
    """How far each node (middle axis) is from each other one (first axis); graphs are on the last."""
    return v[None] - v[:, None]


def fruchterman_reingold(c: Chunk, seeds: list[int]) -> np.ndarray:
    a, (x, y) = c.adjacency.transpose(1, 2, 0).astype(float, order="C"), _starts(c, seeds).transpose(2, 1, 0).copy()
    k, step = 1 / np.sqrt(c.n), 0.1
    for r in range(50):
        ex, ey = _to_all(x), _to_all(y)
        d = np.maximum(np.sqrt(ex * ex + ey * ey), 0.01)
        f = k * k / d**2 - a * d / k
        fx, fy = (ex * f).sum(axis=0), (ey * f).sum(axis=0)
        far = step * (1 - r / 50) / np.maximum(np.hypot(fx, fy), 0.01)
        x, y = x + fx * far, y + fy * far
    return np.stack((x.T, y.T), axis=2)


def forceatlas2(c: Chunk, seeds: list[int]) -> np.ndarray:
    a, (x, y) = c.adjacency.transpose(1, 2, 0).astype(float, order="C"), (_starts(c, seeds) * 10).transpose(2, 1, 0).copy()
    mass, last_x, last_y = a.sum(axis=1) + 1, 0.0, 0.0
    push = 2.0 * mass[:, None] * mass[None]
    for _ in range(100):
        ex, ey = _to_all(x), _to_all(y)
        f = push / np.maximum(ex * ex + ey * ey, 1e-4) - a
        out = np.maximum(np.hypot(x, y), 1e-9)
        fx, fy = ((e * f).sum(axis=0) - v / out * mass for e, v in ((ex, x), (ey, y)))
        swing, size = np.hypot(fx - last_x, fy - last_y), np.maximum(np.hypot(fx, fy), 1e-9)
        speed = np.minimum(0.1 / (1 + np.sqrt(0.1 * swing)), 10 / size)
        x, y, last_x, last_y = x + fx * speed, y + fy * speed, fx, fy
    return np.stack((x.T, y.T), axis=2)


def spectral(c: Chunk, seeds: list[int]) -> np.ndarray:
    lap = 0.0 - c.adjacency
    lap[:, np.arange(c.n), np.arange(c.n)] = c.adjacency.sum(axis=2)
    return _signed(np.linalg.eigh(lap)[1][:, :, 1:3])


def _signed(v: np.ndarray) -> np.ndarray:
    """layouts._signed of each matrix."""
    away = np.abs(v) > 1e-9
    lead = np.take_along_axis(v, away.argmax(axis=1)[:, None], axis=1)
    return np.where(away.any(axis=1)[:, None] & (lead < 0), -v, v)


def pivot_mds(c: Chunk, seeds: list[int], pivots: int = 50) -> np.ndarray:
    d = c.filled_hops()
    chosen = np.zeros((c.size, 1), np.int64)
    near = d[:, :, 0]
    while chosen.shape[1] < min(pivots, c.n):
        x = near.argmax(axis=1)
        chosen = np.column_stack((chosen, x))
        near = np.minimum(near, d[np.arange(c.size), :, x])
    x = d.transpose(0, 2, 1)[np.arange(c.size)[:, None], chosen] ** 2  # pivot by node: layouts.scaled to the last bit
    x = -(x - x.mean(axis=2)[:, :, None] - x.mean(axis=1)[:, None] + x.reshape(c.size, -1).mean(axis=1)[:, None, None]) / 2
    vec = np.linalg.eigh(x @ x.transpose(0, 2, 1))[1]
    return _signed(x.transpose(0, 2, 1) @ vec[:, :, ::-1][:, :, :2])


#: Nodes up to which arcs are looked up: the arcs over so many places on a line are few, and the same for every graph.
ARCS = 32


def _arc(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ten points, in standard form, of the half circles from the places a to the places b of n."""
    a, b = a[:, None], b[:, None]
    turn = np.pi * np.arange(1, 9) / 9
    mid, k = np.array([(n - 1) / 2, 0.0]), 1000 / (n - 1)
    bends = np.stack(((a + b) / 2 - (b - a) / 2 * np.cos(turn), np.abs(b - a) / 2 * np.sin(turn)), axis=2)
    end = lambda x: (np.stack((x, np.zeros_like(x)), axis=2) - mid) * k
    return np.concatenate((end(a), (bends - mid) * k, end(b)), axis=1)


class _Arcs:
    """What scores ask of the arcs over n places, by a * n + b, and of two of them; n is at most ARCS."""

    def __init__(self, n: int) -> None:
        a, b = (x.astype(float).ravel() for x in np.indices((n, n)))
        points = _arc(n, a, b)
        self.n, d = n, np.diff(points, axis=1)
        self.length = np.hypot(d[..., 0], d[..., 1]).sum(axis=1)
        tilt = np.degrees(np.arctan2(np.abs(d[..., 1]), np.abs(d[..., 0])))
        self.tilt = np.minimum(tilt, 90 - tilt).sum(axis=1) / 9
        self.out, self.back = (np.degrees(np.arctan2(e[:, 1], e[:, 0])) for e in (d[:, 0], -d[:, -1]))
        nodes, at = (np.arange(n) - (n - 1) / 2) * (1000 / (n - 1)), np.arange(n * n)
        self.near = (np.abs(nodes - (nodes[at // n] + nodes[at % n])[:, None] / 2) < np.abs(nodes[at // n] - nodes[at % n])[:, None] / 2 - 1e-9).sum(axis=1)
        rel = nodes - points[:, :-1, :1], -points[:, :-1, 1:]
        l2 = (d * d).sum(axis=2)
        t = np.clip((rel[0] * d[..., :1] + rel[1] * d[..., 1:]) / np.where(l2 > 0, l2, 1)[..., None], 0, 1)
        hit = ((rel[0] - t * d[..., :1]) ** 2 + (rel[1] - t * d[..., 1:]) ** 2 < 7.5**2).any(axis=1)
        hit[at, at // n] = hit[at, at % n] = False
        self.touched = hit.any(axis=1)
        self.crossings, self.off = np.zeros((n * n, n * n), np.int8), np.zeros((n * n, n * n))
        self._cross(points)

    def _cross(self, points: np.ndarray) -> None:
        """crossings and off (the sum of how far their angles are from 90 degrees). Only arcs of which each has one end under the
        other meet: an arc within another is a whole place nearer to its centre, more than the ten points cut off."""
        n, seg = self.n, np.concatenate((points[:, :-1], points[:, 1:]), axis=2).reshape(-1, 4)
        p, q = np.triu_indices(n, 1)
        i, j = np.nonzero((p[:, None] < p) & (p < q[:, None]) & (q[:, None] < q))
        low, high = (f(points[p * n + q, :-1], points[p * n + q, 1:]) for f in (np.minimum, np.maximum))
        for s in range(0, len(i), 4096):
            a, b = i[s : s + 4096], j[s : s + 4096]
            meet = np.ones((len(a), 9, 9), bool)
            for k in (0, 1):  # boxes that don't overlap, but for rounding
                meet &= (low[a, :, None, k] <= high[b, None, :, k] + 1e-6) & (low[b, None, :, k] <= high[a, :, None, k] + 1e-6)
            at, e, f = np.nonzero(meet)
            a, b = a[at], b[at]
            for x, e_x in ((p[a] * n + q[a], e), (q[a] * n + p[a], 8 - e)):
                for y, f_y in ((p[b] * n + q[b], f), (q[b] * n + p[b], 8 - f)):
                    at, angles = _crossing(seg, x * 9 + e_x, y * 9 + f_y)
                    np.add.at(self.crossings, (x[at], y[at]), 1)
                    np.add.at(self.off, (x[at], y[at]), np.abs(90 - angles))
        self.crossings += self.crossings.T
        self.off += self.off.T


#: Those of every size that this process has met.
_arcs = functools.cache(_Arcs)


def _bfs_order(a: np.ndarray, deg: np.ndarray) -> np.ndarray:
    """layouts.bfs_order."""
    by = np.argsort(deg, kind="stable")
    near, ends = np.nonzero(a[by][:, by])[1].tolist(), np.cumsum(deg[by]).tolist()
    seen, out = [False] * len(by), []
    for s in range(len(by)):
        todo = [] if seen[s] else [s]
        seen[s] = True
        for x in todo:
            for y in near[ends[x - 1] if x else 0 : ends[x]]:
                if not seen[y]:
                    seen[y] = True
                    todo.append(y)
        out += todo
    return by[out]


def arc_bfs(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Places in standard form, and the ten points of every edge; up to ARCS nodes, the number of every edge's arc."""
    x = np.empty((c.size, c.n))
    for row, a, deg in zip(x, c.adjacency, c.deg, strict=True):
        row[_bfs_order(a, deg)] = np.arange(c.n)
    xy = (np.stack((x, np.zeros_like(x)), axis=2) - np.array([(c.n - 1) / 2, 0.0])) * (1000 / (c.n - 1))
    a, b = x[c.of, c.us], x[c.of, c.vs]
    return xy, (a * c.n + b).astype(int) if c.n <= ARCS else _arc(c.n, a, b)


#: Layouts without bends that every graph of a chunk can have: chunk, seeds -> places. The others run graph by graph.
LAYOUTS: dict[str, Callable[[Chunk, list[int]], np.ndarray]] = {
    "circular": circular, "fruchterman-reingold": fruchterman_reingold, "forceatlas2": forceatlas2, "kamada-kawai": kamada_kawai,
    "pivot-mds": pivot_mds, "random": random, "spectral": spectral, "stress-majorization": stress_majorization,
}


def standardised(xy: np.ndarray) -> np.ndarray:
    """Each drawing's centre at 0, its diagonal 1000."""
    low, high = xy.min(axis=1), xy.max(axis=1)
    diag = np.hypot(*(high - low).T)
    return (xy - ((low + high) / 2)[:, None]) * np.where(diag > 0, 1000 / np.where(diag > 0, diag, 1), 1.0)[:, None, None]


def _turn(p: list[np.ndarray], q: list[np.ndarray], r: list[np.ndarray]) -> np.ndarray:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _crossing(seg: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs i, j of segments that cross properly (their positions), and their acute angles."""
    low, high = np.minimum(seg[:, :2], seg[:, 2:]).T.copy(), np.maximum(seg[:, :2], seg[:, 2:]).T.copy()
    at = np.arange(len(i))
    for axis in (0, 1):  # boxes that don't overlap hold no crossing
        ok = np.flatnonzero((low[axis][i] <= high[axis][j]) & (low[axis][j] <= high[axis][i]))
        at, i, j = at[ok], i[ok], j[ok]
    flat = seg.T.copy()
    for _ in range(2):  # the ends of the second on both sides of the first, and the other way round
        s, t = [x[i] for x in flat], [x[j] for x in flat]
        ok = np.flatnonzero(_turn(s[:2], s[2:], t[:2]) * _turn(s[:2], s[2:], t[2:]) < 0)
        at, i, j = at[ok], j[ok], i[ok]
    s, t = seg[i], seg[j]
    e, f = s[:, 2:] - s[:, :2], t[:, 2:] - t[:, :2]
    return at, np.degrees(np.arctan2(np.abs(e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]), np.abs((e * f).sum(axis=1))))


def _near(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of segments of one drawing whose boxes overlap: each meets those that begin in x no later than it ends."""
    low, high = np.minimum(seg[:, 0], seg[:, 2]), np.maximum(seg[:, 0], seg[:, 2])
    by = np.argsort(low, kind="stable")
    count = np.searchsorted(low[by], high[by], side="right") - np.arange(len(by)) - 1
    first = np.repeat(np.arange(len(by)), count)
    second = np.arange(len(first)) + np.repeat(np.arange(1, len(by) + 1) - np.cumsum(count) + count, count)
    low, high = np.minimum(seg[by, 1], seg[by, 3]), np.maximum(seg[by, 1], seg[by, 3])
    ok = np.flatnonzero((low[first] <= high[second]) & (low[second] <= high[first]))
    return by[first[ok]], by[second[ok]]


def _beside(c: Chunk, xy: np.ndarray, a: np.ndarray, d: np.ndarray, radius: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges straight from a along d: for each node (first axis) the side of the edge on which it is (-1, 0, 1); the number of
    nodes in the circle over the edge; whether a node but its ends is within the root of reach."""
    (x, y), (du, dv), all_edges = (np.take(v, c.of, axis=1) for v in xy.transpose(2, 1, 0)), d.T.copy(), np.arange(len(a))
    x -= a[:, 0]
    y -= a[:, 1]
    along, turn = x * du, du * y
    part = y * dv
    along += part
    np.multiply(x, dv, out=part)
    turn -= part
    side = (turn > 0).view(np.int8) - (turn < 0).view(np.int8)
    x *= x
    y *= y
    x += y  # the squared distance from a
    np.subtract(x, along, out=y)
    near = y < np.where(radius > 1e-9, 1e-18 - 2e-9 * radius, -np.inf)
    near[c.us, all_edges] = near[c.vs, all_edges] = False
    l2 = du * du + dv * dv
    np.maximum(along, 0, out=y)
    np.minimum(y, l2, out=y)
    along *= 2
    along -= y
    along *= y
    along *= 1 / np.where(l2 > 0, l2, np.inf)
    x -= along  # from the edge's nearest point
    hit = x < reach
    hit[c.us, all_edges] = hit[c.vs, all_edges] = False
    return side, near.sum(axis=0), hit.any(axis=0)


@functools.lru_cache(maxsize=256)
def _before(m: int) -> np.ndarray:
    return np.tri(m, k=-1, dtype=bool)


def _crossed(c: Chunk, side: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges straight from a to b that cross properly: the ends of each are on both sides of the other, on which no common
    end is, and their boxes overlap, also where sides are told from rounding alone."""
    firsts, seconds = [], []
    for (us, vs), start, m in zip(c.graphs, c.starts.tolist(), c.m.tolist(), strict=True):
        own = side[:, start : start + m]
        apart = own[us] * own[vs] < 0
        p = np.flatnonzero(_before(m) & apart & apart.T)
        q = p // m
        firsts.append(q + start)
        seconds.append(p - q * m + start)
    p, q = np.concatenate(firsts), np.concatenate(seconds)
    low, high = np.minimum(a, b).T.copy(), np.maximum(a, b).T.copy()
    ok = (np.take(low, p, axis=1) <= np.take(high, q, axis=1)) & (np.take(low, q, axis=1) <= np.take(high, p, axis=1))
    ok = ok[0] & ok[1]
    return p[ok], q[ok]


def _pairs_of_arcs(c: Chunk, arcs: _Arcs, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each graph, the number of crossings of its arcs, and the sum of how far their angles are from 90 degrees."""
    count, off = np.zeros(c.size, np.int64), np.zeros(c.size)
    for g, (start, m) in enumerate(zip(c.starts.tolist(), c.m.tolist(), strict=True)):
        own = at[start : start + m]
        both = (own[:, None] * arcs.n**2 + own)[_before(m)]
        times = np.take(arcs.crossings, both)
        count[g], off[g] = times.sum(), np.take(arcs.off, both[times > 0]).sum()
    return count, off


def _pooled(dist: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """kernels.isotonic of each row, where hops are in order and dist is where hops are alike. One value of hops after the other is
    put behind those before: what is above a level before it and below it there takes this level, their mean."""
    flat = dist.copy()
    for h in range(2, int(hops.max()) + 1):
        rows = np.flatnonzero((hops == h).any(axis=1) & (hops < h).any(axis=1))
        y, own = flat[rows], hops[rows]
        new, known = own == h, own <= h
        level = (np.where(own < h, y, -np.inf).max(axis=1) + np.where(new, y, np.inf).min(axis=1)) / 2
        for _ in range(60):
            some, last = ((y > level[:, None]) != new) & known, level
            count = some.sum(axis=1)
            level = np.where(count > 0, np.einsum("ij,ij->i", y, some) / np.maximum(count, 1), level)
            if (np.abs(level - last) <= 1e-13 * np.abs(level)).all():
                break
        else:
            return np.array([kernels.isotonic(x) for x in dist])
        flat[rows] = np.where(some, level[:, None], y)
    return flat


def _bent(c: Chunk, xy: np.ndarray, a: np.ndarray, b: np.ndarray, lines: list[dict[int, np.ndarray]] | np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of edges by their points: length, mean angle to the nearer axis, directions at both ends, whether a node is near; of each
    graph, the number of crossings, and the sum of how far their angles are from 90 degrees."""
    n, of, m = c.n, c.of, c.m
    if isinstance(lines, np.ndarray):
        seg, parts = np.concatenate((lines[:, :-1], lines[:, 1:]), axis=2).reshape(-1, 4), np.full(len(of), lines.shape[1] - 1)
    else:
        pieces = [np.asarray(own[e], float) if e in own else np.array([a[s + e], b[s + e]]) for own, s, count in zip(lines, c.starts.tolist(), m.tolist(), strict=True) for e in range(count)]
        seg, parts = np.concatenate([np.hstack((p[:-1], p[1:])) for p in pieces]), np.array([len(p) - 1 for p in pieces])
    edge = np.repeat(np.arange(len(of)), parts)
    last, d = np.cumsum(parts) - 1, seg[:, 2:] - seg[:, :2]
    length = np.bincount(edge, np.hypot(d[:, 0], d[:, 1]), len(of))
    tilt = np.degrees(np.arctan2(np.abs(d[:, 1]), np.abs(d[:, 0])))
    tilt = np.bincount(edge, np.minimum(tilt, 90 - tilt), len(of)) / parts
    leaves, back = (np.degrees(np.arctan2(e[:, 1], e[:, 0])) for e in (d[last - parts + 1], -d[last]))

    ends, pairs = np.append(last[c.starts] - parts[c.starts] + 1, len(seg)), []
    for s, t in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        p, q = (x + s for x in _near(seg[s:t]))
        ep, eq = edge[p], edge[q]
        ok = (ep != eq) & (c.us[ep] != c.us[eq]) & (c.us[ep] != c.vs[eq]) & (c.vs[ep] != c.us[eq]) & (c.vs[ep] != c.vs[eq])
        pairs.append(np.where(ep[ok] < eq[ok], [p[ok], q[ok]], [q[ok], p[ok]]))
    p, q = np.concatenate(pairs, axis=1)
    at, angles = _crossing(seg, p, q)
    whose = of[edge[p[at]]]

    touched, l2 = np.zeros(len(seg), bool), (d * d).sum(axis=1)
    for s in range(0, len(seg), max(1, PAIRS // n)):
        part = slice(s, s + max(1, PAIRS // n))
        own, du, dv, at = edge[part], d[part, :1], d[part, 1:], of[edge[part]]
        px, py = xy[at, :, 0] - seg[part, :1], xy[at, :, 1] - seg[part, 1:2]
        t = np.clip((px * du + py * dv) / np.where(l2[part] > 0, l2[part], 1)[:, None], 0, 1)
        hit = (px - t * du) ** 2 + (py - t * dv) ** 2 < reach[at][:, None]
        hit[np.arange(len(own)), c.us[own]] = hit[np.arange(len(own)), c.vs[own]] = False
        touched[part] = hit.any(axis=1)
    return length, tilt, leaves, back, np.bincount(edge, touched, len(of)) > 0, np.bincount(whose, minlength=c.size), np.bincount(whose, np.abs(90 - angles), c.size)


def scores(c: Chunk, xy: np.ndarray, lines: list[dict[int, np.ndarray]] | np.ndarray | None = None) -> dict[str, np.ndarray]:
    """scores.score of a drawing of each graph: an array for each name, NaN where a drawing has none. lines: the points of edges
    that aren't straight, by number, for each graph; those of all edges, equally many; or the numbers of arcs."""
    n, size, of, m = c.n, c.size, c.of, c.m
    out = {name: np.full(size, np.nan) for name in NAMES}
    low = xy.min(axis=1)
    span = xy.max(axis=1) - low
    diag, long = np.hypot(*span.T), span.max(axis=1)
    ratio = lambda a, b, none: np.where(b > 0, a / np.where(b > 0, b, 1), none)
    out["aspect_ratio"] = ratio(span.min(axis=1), long, 1.0)
    x, y = (np.take(v, c.i, axis=1) - np.take(v, c.j, axis=1) for v in xy.transpose(2, 0, 1).copy())
    far = np.sqrt(x * x + y * y)
    out["node_resolution"] = ratio(far.min(axis=1), diag, np.nan)
    k = int(np.ceil(np.sqrt(n)))
    cell = np.minimum(k - 1, np.floor((xy - low[:, None]) / np.where(span > 0, span, 1)[:, None] * k)).astype(int)
    inside = np.bincount((np.arange(size)[:, None] * k * k + cell[..., 0] * k + cell[..., 1]).ravel(), minlength=size * k * k).reshape(size, -1)
    out["node_uniformity"] = 1 - np.abs(inside - n / k**2).sum(axis=1) / (2 * n * (1 - 1 / k**2))

    a, b = xy[of, c.us], xy[of, c.vs]
    gap = np.empty((size, n, n))
    gap[:, c.i, c.j] = gap[:, c.j, c.i] = far
    gap[:, np.arange(n), np.arange(n)] = np.inf
    reach = (diag * 7.5 / 1000) ** 2
    if lines is None:
        d, length = b - a, gap[of, c.us, c.vs]
        side, near, touched = _beside(c, xy, a, d, length / 2, reach[of])
        turn = np.degrees(np.arctan2(d[:, 1], d[:, 0]))
        leaves, back, tilt = turn, np.where(turn > 0, turn - 180, turn + 180), np.abs(turn)
        tilt = np.minimum(tilt, 180 - tilt)
        tilt = np.minimum(tilt, 90 - tilt)
        p, q = _crossed(c, side, a, b)
        crossed = np.bincount(of[p], minlength=size)
        off = np.bincount(of[p], np.abs(90 - np.abs(np.mod(turn[p], 180) - np.mod(turn[q], 180))), size)
    elif isinstance(lines, np.ndarray) and lines.ndim == 1:
        arcs = _arcs(n)
        near, length, tilt, leaves, back, touched = (x[lines] for x in (arcs.near, arcs.length, arcs.tilt, arcs.out, arcs.back, arcs.touched))
        crossed, off = _pairs_of_arcs(c, arcs, lines)
    else:
        _, near, _ = _beside(c, xy, a, b - a, gap[of, c.us, c.vs] / 2, reach[of])
        length, tilt, leaves, back, touched, crossed, off = _bent(c, xy, a, b, lines, reach)
    out["gabriel_ratio_nodes"] = 1 - c.total(near) / (m * (n - 2))
    mean = c.total(length) / m
    out["edge_length_deviation"] = np.where(mean > 0, 1 / (1 + ratio(c.total(np.abs(length - mean[of])) / m, mean, 0.0)), 1.0)
    out["edge_orthogonality"] = 1 - c.total(tilt) / m / 45
    most = m * (m - 1) / 2 - (c.deg * (c.deg - 1)).sum(axis=1) / 2
    out["edge_crossings"] = np.maximum(0.0, 1 - ratio(crossed, most, 0.0))
    out["crossing_angle"] = 1 - ratio(off, crossed, 0.0) / 90
    out["node_edge_occlusion"] = 1 - c.total(touched) / m

    node, turn = np.concatenate((of * n + c.us, of * n + c.vs)), np.concatenate((leaves, back))
    by = np.argsort(node * 1024.0 + turn)  # by node, then by turn, where it isn't alike to rounding
    node, turn = node[by], turn[by]
    begins = np.flatnonzero(np.diff(node, prepend=-1))
    fan = np.diff(np.append(begins, len(node)))
    step = np.diff(turn, append=0.0)
    step[begins + fan - 1] = turn[begins] + 360 - turn[begins + fan - 1]  # round to the first
    least, ideal = np.minimum.reduceat(step, begins), 360 / fan
    some, whose = fan > 1, node[begins] // n
    count = np.bincount(whose[some], minlength=size)
    out["angular_resolution"] = 1 - ratio(np.bincount(whose[some], (np.abs(ideal - least) / ideal)[some], size), count, np.nan)

    key = np.rint(gap * 1e9) + np.arange(n) / (2 * n)  # equal to nine places: the lesser number first
    nearest = key <= np.take_along_axis(np.sort(key, axis=2), np.maximum(c.deg - 1, 0)[..., None], axis=2)
    nearest &= c.deg[..., None] > 0
    out["neighbourhood_preservation"] = (c.adjacency & nearest).sum(axis=(1, 2)) / (c.adjacency | nearest).sum(axis=(1, 2))

    joined, hops, ranks = c.steps
    if len(joined):
        far = far[joined]
        above = 2.0 ** np.ceil(np.log2(np.maximum(far.max(axis=1, keepdims=True), 1e-300)) + 1)  # a power of two, so that only far is rounded
        dist = np.take_along_axis(far, np.argsort(hops * above + far, axis=1), axis=1)
        total, flat = (dist**2).sum(axis=1), _pooled(dist, ranks)
        out["kruskal_stress"][joined] = 1 - np.sqrt(ratio(((dist - flat) ** 2).sum(axis=1), total, np.nan))
    return out
