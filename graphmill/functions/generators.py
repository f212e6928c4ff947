"""Random graph families and fixed catalogues: each gives (n, us, vs) with us < vs, sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

from . import kernels

Graph = tuple[int, np.ndarray, np.ndarray]


class Family(NamedTuple):
    make: Callable[[np.random.Generator, int], Graph]
    weight: float
    least: int


FAMILIES: dict[str, Family] = {}


def register(name: str, weight: float, least: int) -> Callable:
    def add(f: Callable[[np.random.Generator, int], Graph]) -> Callable:
        if name in FAMILIES:
            raise ValueError(f"family {name} exists")
        FAMILIES[name] = Family(f, weight, least)
        return f

    return add


def graph(n: int, pairs: object) -> Graph:
    """Loops and repeated pairs are dropped."""
    got = sorted({(min(a, b), max(a, b)) for a, b in ((int(p), int(q)) for p, q in pairs) if a != b})
    return n, np.array([e[0] for e in got], np.int64), np.array([e[1] for e in got], np.int64)


def _from_mask(mask: np.ndarray) -> Graph:
    us, vs = np.nonzero(np.triu(mask, 1))
    return len(mask), us, vs


@register("er", 1.0, 3)
def er(r: np.random.Generator, n: int) -> Graph:
    """Each pair with probability 2/n + (0.5 - 2/n) Beta(2, 3)."""
    p = 2 / n + (0.5 - 2 / n) * r.beta(2, 3)
    return _from_mask(r.random((n, n)) < p)


@register("bba", 1.0, 2)
def bba(r: np.random.Generator, n: int) -> Graph:
    """Preferential attachment of m in [2, max(2, n // 10)] edges for each new node."""
    m = int(r.integers(2, max(2, n // 10) + 1))
    m = min(m, n - 1)
    pairs, ends = [], list(range(m))
    for x in range(m, n):
        to: set[int] = set()
        while len(to) < min(m, x):
            to.add(int(ends[r.integers(len(ends))]))
        pairs += [(x, y) for y in to]
        ends += [*to, *[x] * len(to)]
    return graph(n, pairs)


@register("nws", 1.0, 4)
def nws(r: np.random.Generator, n: int) -> Graph:
    """A ring of width k, drawn from 2 .. n // 4 and made even upwards (below n), and for each of its edges a shortcut with
    probability 0.1 + 0.9 Beta(1, 3)."""
    k = int(r.integers(2, max(2, n // 4) + 1))
    k = min(k + k % 2, (n - 1) // 2 * 2)
    p = 0.1 + 0.9 * r.beta(1, 3)
    ring = [(x, (x + d) % n) for d in range(1, k // 2 + 1) for x in range(n)]
    return graph(n, ring + [(x, int(r.integers(n))) for x, _ in ring if r.random() < p])


def parts(r: np.random.Generator, n: int, k: int, least: int) -> np.ndarray:
    """Part of each node: k parts of at least least nodes."""
    spare = r.multinomial(n - k * least, r.dirichlet(np.ones(k)))
    return np.repeat(np.arange(k), spare + least)


@register("sbm", 1.2, 6)
def sbm(r: np.random.Generator, n: int) -> Graph:
    """2 to min(n / 3, 6) blocks of 3 or more; inside 0.3 + 0.7 Beta(2, 2), across 0.02 + 0.2 Beta(1, 10)."""
    block = parts(r, n, int(r.integers(2, min(n // 3, 6) + 1)), 3)
    inside, across = 0.3 + 0.7 * r.beta(2, 2), 0.02 + 0.2 * r.beta(1, 10)
    return _from_mask(r.random((n, n)) < np.where(block[:, None] == block[None], inside, across))


def _power(r: np.random.Generator, tau: float, low: int, high: int, size: int) -> np.ndarray:
    x = np.arange(low, high + 1, dtype=float) ** -tau
    return r.choice(np.arange(low, high + 1), size, p=x / x.sum())


def _degrees(r: np.random.Generator, tau: float, mean: float, n: int) -> np.ndarray:
    """Degrees below n with a power law whose expected value is mean: the least degree is the one with which it comes
    nearest below, and each law's share is mixed with that of the next least degree."""
    at = np.arange(1, n)
    law = lambda low: np.where(at >= low, at**-tau, 0.0) / (np.where(at >= low, at**-tau, 0.0)).sum()
    low = max((k for k in range(1, n - 1) if law(k) @ at <= mean), default=1)
    a, b = law(low), law(low + 1)
    share = np.clip((mean - a @ at) / (b @ at - a @ at), 0, 1)
    return r.choice(at, n, p=(1 - share) * a + share * b)


@register("lfr", 1.2, 20)
def lfr(r: np.random.Generator, n: int) -> Graph:
    """Power-law degrees (exponent 2 to 3) of a mean drawn from 4 to min(8, n / 4), community sizes by a power law (1.5 to 3)
    from max(3, n // 10) up; a share mu in [0.1, 0.5] of a node's edges leaves its community. Free ends are matched at
    random; what can't be matched is dropped."""
    tau, tau2, mu = r.uniform(2, 3), r.uniform(1.5, 3), r.uniform(0.1, 0.5)
    deg = _degrees(r, tau, r.uniform(4, min(8, n / 4)), n)
    low = max(3, n // 10)
    sizes: list[int] = []
    while sum(sizes) < n:
        sizes.append(int(_power(r, tau2, low, max(low + 1, n // 2), 1)[0]))
    if len(sizes) > 1 and n - sum(sizes[:-1]) < low:  # no rest below the least size
        sizes.pop()
        sizes[-1] += n - sum(sizes)
    member = r.permutation(np.repeat(np.arange(len(sizes)), sizes)[:n])
    inner = np.minimum(np.round((1 - mu) * deg).astype(int), np.bincount(member, minlength=len(sizes))[member] - 1)
    pairs = []
    for pool in [np.repeat(np.flatnonzero(member == c), inner[member == c]) for c in range(len(sizes))] + [np.repeat(np.arange(n), np.maximum(deg - inner, 0))]:
        pool = r.permutation(pool)
        pairs += zip(pool[: len(pool) // 2], pool[len(pool) // 2 :], strict=False)
    return graph(n, pairs)


@register("geo", 1.2, 4)
def geo(r: np.random.Generator, n: int) -> Graph:
    """Points in a square joined within a radius from sqrt(1.2 ln n / (pi n)) (no more than 0.9 of the greatest) to the
    greatest, sqrt(0.5), the place between them by Beta(1, 3)."""
    at = r.random((n, 2))
    d2 = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    high = np.sqrt(0.5)
    low = min(np.sqrt(1.2 * np.log(n) / (np.pi * n)), 0.9 * high)
    return _from_mask(d2 <= (low + (high - low) * r.beta(1, 3)) ** 2)


@register("hrg", 1.2, 10)
def hrg(r: np.random.Generator, n: int) -> Graph:
    """Points in a hyperbolic disc (alpha in [0.55, 0.95], mean degree in [4, 10]) joined within its radius."""
    alpha, mean = r.uniform(0.55, 0.95), r.uniform(4, 10)
    radius = 2 * np.log(2 * n * alpha**2 / (np.pi * mean * (alpha - 0.5) ** 2))
    rad = np.arccosh(1 + r.random(n) * (np.cosh(alpha * radius) - 1)) / alpha
    turn = r.random(n) * 2 * np.pi
    gap = np.pi - np.abs(np.pi - np.abs(turn[:, None] - turn[None]))
    cosh = np.cosh(rad[:, None]) * np.cosh(rad[None]) - np.sinh(rad[:, None]) * np.sinh(rad[None]) * np.cos(gap)
    return _from_mask(cosh <= np.cosh(radius))


@register("tree_uniform", 1.0, 2)
def tree_uniform(r: np.random.Generator, n: int) -> Graph:
    """A uniform labelled tree, from a random Pruefer sequence."""
    code = r.integers(0, n, max(0, n - 2)).tolist()
    left = np.bincount(code, minlength=n) + 1
    pairs = []
    for x in code:
        leaf = int(np.flatnonzero(left == 1)[0])
        pairs.append((leaf, x))
        left[leaf] = 0
        left[x] -= 1
    return graph(n, [*pairs, tuple(np.flatnonzero(left == 1)[:2])])


@register("caterpillar", 0.8, 4)
def caterpillar(r: np.random.Generator, n: int) -> Graph:
    """A path of n / 3 to 2n / 3 nodes, the rest hung onto it at random."""
    spine = int(r.integers(max(2, n // 3), max(2, 2 * n // 3) + 1))
    return graph(n, [(i, i + 1) for i in range(spine - 1)] + [(x, int(r.integers(spine))) for x in range(spine, n)])


def delaunay(at: np.ndarray) -> set[tuple[int, int]]:
    """Edges of triangles whose circle holds no other point; all triples are looked at, block by block."""
    n = len(at)
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    ok = (i < j) & (j < k)
    i, j, k = i[ok], j[ok], k[ok]
    out: set[tuple[int, int]] = set()
    for s in range(0, len(i), 20_000):
        a, b, c = at[i[s : s + 20_000]], at[j[s : s + 20_000]], at[k[s : s + 20_000]]
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        flat = np.abs(d) < 1e-12
        d = np.where(flat, 1, d)
        qa, qb, qc = ((p**2).sum(axis=1) for p in (a, b, c))
        mid = np.column_stack(((qa * (b[:, 1] - c[:, 1]) + qb * (c[:, 1] - a[:, 1]) + qc * (a[:, 1] - b[:, 1])) / d, (qa * (c[:, 0] - b[:, 0]) + qb * (a[:, 0] - c[:, 0]) + qc * (b[:, 0] - a[:, 0])) / d))
        r2 = ((a - mid) ** 2).sum(axis=1)
        inside = ((at[None] - mid[:, None]) ** 2).sum(axis=2) < r2[:, None] * (1 - 1e-9)
        for t in np.flatnonzero(~inside.any(axis=1) & ~flat):
            x, y, z = int(i[s + t]), int(j[s + t]), int(k[s + t])
            out |= {(x, y), (y, z), (x, z)}
    return out


@register("planar_max", 1.5, 4)
def planar_max(r: np.random.Generator, n: int) -> Graph:
    """A Delaunay triangulation of which a spanning tree and, in all, a share in [0.5, 1] of the edges stay."""
    edges = [tuple(e) for e in r.permutation(sorted(delaunay(r.random((n, 2)))))]
    keep, root = [], list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rest = []
    for a, b in edges:
        p, q = find(a), find(b)
        (rest if p == q else keep).append((a, b))
        root[p] = q
    return graph(n, keep + rest[: max(0, round(r.uniform(0.5, 1) * len(edges)) - len(keep))])


@register("k_tree", 1.5, 4)
def k_tree(r: np.random.Generator, n: int) -> Graph:
    """k = 2 with probability 2/3, else 3: every new node joins a clique of k."""
    k = 2 if r.random() < 2 / 3 else 3
    k = min(k, n - 1)
    pairs = [(i, j) for i in range(k + 1) for j in range(i)]
    cliques = [[x for x in range(k + 1) if x != y] for y in range(k + 1)]
    for x in range(k + 1, n):
        base = cliques[int(r.integers(len(cliques)))]
        pairs += [(x, y) for y in base]
        cliques += [[z for z in base if z != y] + [x] for y in base]
    return graph(n, pairs)


@register("k_regular", 0.8, 4)
def k_regular(r: np.random.Generator, n: int) -> Graph:
    """Every degree k in [3, min(n - 1, 8)], one less if n k is odd: a ring lattice whose edges are exchanged many times."""
    k = int(r.integers(3, min(n - 1, 8) + 1))
    k -= n * k % 2
    edges = [(x, (x + d) % n) for d in range(1, k // 2 + 1) for x in range(n)] + [(x, x + n // 2) for x in range(n // 2) if k % 2]
    have = {frozenset(e) for e in edges}
    for _ in range(20 * len(edges)):
        i, j = r.integers(len(edges), size=2)
        (a, b), (c, d) = edges[i], edges[j]
        if r.random() < 0.5:
            c, d = d, c
        new = frozenset((a, c)), frozenset((b, d))
        if len({a, b, c, d}) == 4 and new[0] not in have and new[1] not in have:
            have -= {frozenset((a, b)), frozenset((c, d))}
            have |= {*new}
            edges[i], edges[j] = (a, c), (b, d)
    return graph(n, edges)


def _cycle(n: int) -> list[tuple[int, int]]:
    return [(i, (i + 1) % n) for i in range(n)]


def _lcf(n: int, jumps: list[int]) -> Graph:
    """A Hamiltonian cycle and the chords that repeated jumps give."""
    return graph(n, _cycle(n) + [(i, (i + jumps[i % len(jumps)]) % n) for i in range(n)])


def _truncated(n: int, pairs: list[tuple[int, int]]) -> Graph:
    """Every node of a cubic graph becomes a triangle."""
    slot: dict[tuple[int, int], int] = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            slot[x, y] = 3 * x + sum(1 for p, _ in slot if p == x)
    return graph(3 * n, [(3 * x + i, 3 * x + (i + 1) % 3) for x in range(n) for i in range(3)] + [(slot[a, b], slot[b, a]) for a, b in pairs])


# The sizes of the calibration catalogue.
BIPARTITE = ((2, 3), (2, 4), (2, 5), (2, 7), (3, 3), (3, 4), (3, 5), (3, 7), (4, 4), (4, 5), (4, 6), (4, 7), (5, 5), (5, 6), (5, 7), (6, 6))
GRIDS = (
    (3, 3), (3, 4), (4, 4), (4, 5), (5, 5), (3, 6), (4, 6), (5, 6), (6, 6), (3, 7), (4, 7), (5, 7), (6, 7), (7, 7), (5, 8), (6, 8), (3, 10), (4, 10), (5, 10), (6, 10), (5, 12), (5, 15),
)
CYCLES, PATHS, STARS, WHEELS = (5, 6, 7, 10, 15, 20, 30, 50, 75), (5, 10, 20, 50, 75), (5, 10, 20, 40, 60), (5, 7, 10, 15, 20, 30)


def calibration() -> Iterator[tuple[str, Graph]]:
    """The named graphs of at most 75 nodes."""
    for n in range(5, 11):
        yield f"K_{n}", graph(n, [(i, j) for i in range(n) for j in range(i)])
    for p, q in BIPARTITE:
        yield f"K_{p}_{q}", graph(p + q, [(i, p + j) for i in range(p) for j in range(q)])
    cube = [(x, x ^ 1 << b) for x in range(8) for b in range(3) if x < x ^ 1 << b]
    yield "petersen", graph(10, _cycle(5) + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)])
    yield "heawood", _lcf(14, [5, -5])
    yield "pappus", _lcf(18, [5, 7, -7, 7, -7, -5])
    yield "desargues", _lcf(20, [5, -5, 9, -9])
    yield "dodecahedral", _lcf(20, [10, 7, 4, -4, -7, 10, -4, 7, -7, 4])
    yield "truncated_tetrahedron", _truncated(4, [(i, j) for i in range(4) for j in range(i)])
    yield "truncated_cube", _truncated(8, cube)
    yield "octahedral", graph(6, [(i, j) for i in range(6) for j in range(i) if i - j != 3])
    for n in CYCLES:
        yield f"C_{n}", graph(n, _cycle(n))
    for n in PATHS:
        yield f"P_{n}", graph(n, [(i, i + 1) for i in range(n - 1)])
    for k in STARS:
        yield f"star_{k}", graph(k + 1, [(0, i) for i in range(1, k + 1)])
    for k in WHEELS:
        yield f"W_{k}", graph(k, [(0, i) for i in range(1, k)] + [(1 + i, 1 + (i + 1) % (k - 1)) for i in range(k - 1)])
    for h in (3, 4, 5):
        n = 2 ** (h + 1) - 1
        yield f"bin_tree_h{h}", graph(n, [(i, (i - 1) // 2) for i in range(1, n)])
    for a, b in GRIDS:
        yield f"grid_{a}x{b}", graph(a * b, [(i * b + j, i * b + j + 1) for i in range(a) for j in range(b - 1)] + [(i * b + j, (i + 1) * b + j) for i in range(a - 1) for j in range(b)])
    for d in (3, 4, 5, 6):
        yield f"Q_{d}", graph(2**d, [(x, x ^ 1 << b) for x in range(2**d) for b in range(d)])


@cache
def connected_up_to(n: int) -> list[Graph]:
    """One of each connected graph of 1 to n nodes. Every one of k nodes has a node whose loss leaves it connected, so all
    come from those of k - 1 nodes by one node more; equal ones are found by hash, then by exact comparison."""
    out, last = [graph(1, [])], [graph(1, [])]
    for k in range(2, n + 1):
        met: dict[str, list[Graph]] = {}
        for _, us, vs in last:
            old = list(zip(us.tolist(), vs.tolist(), strict=True))
            for mask in range(1, 1 << (k - 1)):
                g = graph(k, old + [(i, k - 1) for i in range(k - 1) if mask >> i & 1])
                same = met.setdefault(kernels.wl_hash(*g, rounds=3), [])
                if not any(kernels.is_isomorphic(g, h) for h in same):
                    same.append(g)
        last = [g for gs in met.values() for g in gs]
        out += last
    return out
