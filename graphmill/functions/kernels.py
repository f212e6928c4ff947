"""Graph algorithms on one small graph: n nodes 0..n-1 and its edges (us, vs)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np


def adjacency(n: int, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n), bool)
    a[us, vs] = a[vs, us] = True
    return a


def neighbours(n: int, us: np.ndarray, vs: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for u, v in zip(us.tolist(), vs.tolist(), strict=True):
        out[u].append(v)
        out[v].append(u)
    return [sorted(x) for x in out]


def all_distances(n: int, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """Hops between all pairs, not to be written to; -1 where there is no path. The last graphs' are kept, as several layouts
    and scores of one graph follow one another."""
    return _distances(n, np.asarray(us, np.int64).tobytes(), np.asarray(vs, np.int64).tobytes())


@functools.lru_cache(maxsize=8)
def _distances(n: int, u: bytes, v: bytes) -> np.ndarray:
    """All sources go one hop further with each matrix product."""
    us, vs = np.frombuffer(u, np.int64), np.frombuffer(v, np.int64)
    a = adjacency(n, us, vs).astype(np.float32)
    seen = np.eye(n, dtype=bool)
    out, front, hops = np.where(seen, 0, -1), seen, 0
    while front.any():
        hops += 1
        front = (front.astype(np.float32) @ a > 0) & ~seen
        seen |= front
        out[front] = hops
    out.flags.writeable = False
    return out


def n_components(n: int, us: np.ndarray, vs: np.ndarray) -> int:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = n
    for u, v in zip(us.tolist(), vs.tolist(), strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[p], left = q, left - 1
    return left


def distance_summary(n: int, us: np.ndarray, vs: np.ndarray) -> dict:
    """diameter, radius, avg_shortest_path_length: of connected graphs with two nodes or more; one node has 0, 0, null."""
    d = all_distances(n, us, vs)
    if n == 0 or (d < 0).any():
        return dict.fromkeys(("diameter", "radius", "avg_shortest_path_length"))
    far = d.max(axis=1)
    return {"diameter": float(far.max()), "radius": float(far.min()), "avg_shortest_path_length": float(d.sum()) / (n * (n - 1)) if n > 1 else None}


def is_bipartite(n: int, us: np.ndarray, vs: np.ndarray) -> bool:
    near, side = neighbours(n, us, vs), [-1] * n
    for s in range(n):
        if side[s] < 0:
            side[s], todo = 0, [s]
            for x in todo:
                for y in near[x]:
                    if side[y] < 0:
                        side[y] = 1 - side[x]
                        todo.append(y)
                    elif side[y] == side[x]:
                        return False
    return True


def blocks(n: int, us: np.ndarray, vs: np.ndarray) -> list[list[tuple[int, int]]]:
    """Edges of each biconnected component; a bridge is one."""
    near = neighbours(n, us, vs)
    depth, low, out, held = [-1] * n, [0] * n, [], []
    for s in range(n):
        if depth[s] >= 0:
            continue
        depth[s] = low[s] = 0
        path = [(s, -1, iter(near[s]))]
        while path:
            x, up, rest = path[-1]
            for y in rest:
                if y == up:
                    continue
                if depth[y] < 0:
                    held.append((x, y))
                    depth[y] = low[y] = depth[x] + 1
                    path.append((y, x, iter(near[y])))
                    break
                if depth[y] < depth[x]:
                    held.append((x, y))
                    low[x] = min(low[x], depth[y])
            else:
                path.pop()
                if up >= 0:
                    low[up] = min(low[up], low[x])
                    if low[x] >= depth[up]:
                        cut = held.index((up, x))
                        out.append(held[cut:])
                        del held[cut:]
    return out


def degeneracy(n: int, us: np.ndarray, vs: np.ndarray) -> int:
    """The greatest of the least degrees met while nodes of least degree are taken away."""
    a = adjacency(n, us, vs)
    deg, alive, most = a.sum(axis=1), np.ones(n, bool), 0
    for _ in range(n):
        x = int(np.where(alive, deg, n + 1).argmin())
        most = max(most, int(deg[x]))
        alive[x] = False
        deg = deg - a[x]
    return most


def faces_of(edges: list[tuple[int, int]]) -> list[list[int]] | None:
    """Faces of a plane drawing of a biconnected graph with a cycle, None if there is none. Demoucron's way: faces of a
    growing plane subgraph take up one fragment after another."""
    names = sorted({x for e in edges for x in e})
    n, m = len(names), len(edges)
    if m > 3 * n - 6:
        return None
    near: dict[int, set[int]] = {x: set() for x in names}
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    # a first cycle: an edge and a shortest way round it
    s, t = edges[0]
    before, todo = {s: s}, [s]
    for x in todo:
        for y in sorted(near[x]):
            if y not in before and not (x == s and y == t):
                before[y] = x
                todo.append(y)
    cycle = [t]
    while cycle[-1] != s:
        cycle.append(before[cycle[-1]])
    placed = set(cycle)
    drawn = {frozenset((cycle[i], cycle[i - 1])) for i in range(len(cycle))}
    faces = [cycle, cycle[:]]
    while len(drawn) < m:
        fragments: list[tuple[set[int], set[int]]] = []  # inner nodes, touched placed nodes
        for u, v in edges:
            if u in placed and v in placed and frozenset((u, v)) not in drawn:
                fragments.append((set(), {u, v}))
        loose = set(names) - placed
        while loose:
            inner, todo = set(), [loose.pop()]
            touch: set[int] = set()
            while todo:
                x = todo.pop()
                inner.add(x)
                for y in near[x]:
                    if y in placed:
                        touch.add(y)
                    elif y in loose:
                        loose.discard(y)
                        todo.append(y)
            fragments.append((inner, touch))
        best = None
        for inner, touch in fragments:
            fits = [i for i, f in enumerate(faces) if touch <= set(f)]
            if not fits:
                return None
            if best is None or len(fits) < best[0]:
                best = (len(fits), fits[0], inner, touch)
        _, at, inner, touch = best
        start = min(touch)
        if inner:
            before, todo, goal = {start: start}, [start], None
            while todo and goal is None:
                x = todo.pop(0)
                for y in sorted(near[x]):
                    if y in before:
                        continue
                    if y in inner:
                        before[y] = x
                        todo.append(y)
                    elif x != start and y in touch:
                        before[y], goal = x, y
                        break
            path = [goal]
            while path[-1] != start:
                path.append(before[path[-1]])
        else:
            path = [max(touch), start]
        drawn |= {frozenset(p) for p in zip(path, path[1:], strict=False)}
        placed |= set(path)
        face = faces.pop(at)
        i, j = face.index(path[0]), face.index(path[-1])
        if i > j:
            i, j, path = j, i, path[::-1]
        # path runs from face[i] to face[j]
        faces.append(face[: i + 1] + path[1:-1] + face[j:])
        faces.append(face[i : j + 1] + path[-2:0:-1])
    return faces


def _block_is_planar(edges: list[tuple[int, int]]) -> bool:
    n = len({x for e in edges for x in e})
    return n <= 4 or len(edges) <= 8 or faces_of(edges) is not None


def is_planar(n: int, us: np.ndarray, vs: np.ndarray) -> bool:
    if n > 2 and len(us) > 3 * n - 6:
        return False
    return all(_block_is_planar(b) for b in blocks(n, us, vs))


def wl_colours(n: int, us: np.ndarray, vs: np.ndarray, rounds: int = 5) -> list[str]:
    """Labels of nodes: degrees, then so many times a hash of the own and the neighbours' labels."""
    near = neighbours(n, us, vs)
    label = [str(len(x)) for x in near]
    for _ in range(rounds):
        label = [hashlib.blake2b((label[x] + "|" + ",".join(sorted(label[y] for y in near[x]))).encode(), digest_size=8).hexdigest() for x in range(n)]
    return label


def wl_hash(n: int, us: np.ndarray, vs: np.ndarray, rounds: int = 5) -> str:
    """Equal for isomorphic graphs."""
    return hashlib.blake2b(",".join(sorted(wl_colours(n, us, vs, rounds))).encode(), digest_size=8).hexdigest()


def is_isomorphic(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> bool:
    """Whether two graphs are the same up to names: nodes meet nodes of equal label, rarest labels first."""
    if a[0] != b[0] or len(a[1]) != len(b[1]):
        return False
    ca, cb = wl_colours(*a), wl_colours(*b)
    if sorted(ca) != sorted(cb):
        return False
    n, ma, mb = a[0], adjacency(*a), adjacency(*b)
    count = {c: ca.count(c) for c in set(ca)}
    order = sorted(range(n), key=lambda x: (count[ca[x]], ca[x], x))
    choices = [[y for y in range(n) if cb[y] == ca[x]] for x in order]
    image, used, tries = [-1] * n, [False] * n, [0] * n
    i = 0
    while 0 <= i < n:
        x = order[i]
        if image[x] >= 0:
            used[image[x]], image[x] = False, -1
        while tries[i] < len(choices[i]):
            y = choices[i][tries[i]]
            tries[i] += 1
            if not used[y] and all(ma[x, order[j]] == mb[y, image[order[j]]] for j in range(i)):
                image[x], used[y] = y, True
                break
        if image[x] >= 0:
            i += 1
            if i < n:
                tries[i] = 0
        else:
            tries[i] = 0
            i -= 1
    return i == n


def isotonic(y: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y in squares: neighbours that go down are pooled. Behind a value that isn't pooled, a
    run that goes up is taken over whole."""
    sums, sizes, values, i = [], [], y.tolist(), 0
    for end in [*(np.flatnonzero(y[1:] < y[:-1]) + 1).tolist(), len(values)]:
        while i < end:
            total, size, i = values[i], 1, i + 1
            while sums and sums[-1] * size > total * sizes[-1]:
                total, size = sums.pop() + total, sizes.pop() + size
            sums.append(total)
            sizes.append(size)
            if size == 1:
                sums += values[i:end]
                sizes += [1] * (end - i)
                i = end
    return np.repeat(np.array(sums) / np.array(sizes), sizes)


def upgma(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of average linkage; ties go to the smallest pair of numbers; a merge is numbered
    behind all before it."""
    n = len(d)
    size = {i: 1 for i in range(n)}
    far = {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}
    out = []
    for k in range(n, 2 * n - 1):
        (a, b), h = min(far.items(), key=lambda x: (x[1], x[0]))
        for x in [x for x in size if x not in (a, b)]:
            p, q = far.pop((min(a, x), max(a, x))), far.pop((min(b, x), max(b, x)))
            far[(x, k)] = (p * size[a] + q * size[b]) / (size[a] + size[b])
        del far[(a, b)]
        size[k] = size.pop(a) + size.pop(b)
        out.append((a, b, h, size[k]))
    return out


def flat_clusters(n: int, merges: list[tuple[int, int, float, int]], cut: float) -> tuple[list[int], list[int]]:
    """Cluster of each leaf, numbered along the leaf order, and the leaf order, of merges up to height cut."""
    below = {i: [i] for i in range(n)}
    flat = {i: [i] for i in range(n)}
    for k, (a, b, h, _) in enumerate(merges, n):
        below[k] = below[a] + below[b]
        if h <= cut and a in flat and b in flat:
            flat[k] = flat.pop(a) + flat.pop(b)
    order = below[n + len(merges) - 1] if merges else list(range(n))
    cluster, names = [0] * n, {}
    for leaf in order:
        top = next(k for k, v in flat.items() if leaf in v)
        cluster[leaf] = names.setdefault(top, len(names))
    return cluster, order
