"""Readability of one drawing in numpy, also with bent or curved edges; see operators.drawings for the definitions."""

from __future__ import annotations

import re

import numpy as np

from . import kernels

NAMES = [
    "angular_resolution", "aspect_ratio", "crossing_angle", "edge_crossings", "edge_length_deviation", "edge_orthogonality", "gabriel_ratio_nodes", "kruskal_stress",
    "neighbourhood_preservation", "node_edge_occlusion", "node_resolution", "node_uniformity",
]
FLAGS = ["contains_bends", "contains_curves"]
#: Points by which a curve is followed, and segment pairs that are looked at together.
STEPS, PAIRS = 16, 1 << 20
_WORD = re.compile(r"[A-Za-z]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def polyline(path: str) -> np.ndarray:
    """Points along an SVG path. Cubic and quadratic curves are followed by STEPS points, arcs by their chord."""
    at, start, out = np.zeros(2), np.zeros(2), []
    words = _WORD.findall(path)
    i, cmd, handle = 0, "", None
    need = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    t = np.linspace(0, 1, STEPS + 1)[1:, None]
    while i < len(words):
        if words[i].isalpha():
            cmd, i = words[i], i + 1
            if cmd.upper() not in need:
                raise ValueError(f"path command {cmd}")
        up, k = cmd.upper(), need[cmd.upper()]
        x = np.array([float(w) for w in words[i : i + k]])
        if len(x) < k:
            raise ValueError("path ends early")
        i += k
        base = at if cmd.islower() else np.zeros(2)
        if up == "Z":
            at = start
            out.append(at)
        elif up in "HV":
            at = np.array([x[0] + base[0], at[1]]) if up == "H" else np.array([at[0], x[0] + base[1]])
            out.append(at)
        elif up == "A":
            at = x[5:] + base
            out.append(at)
        else:
            pts = x.reshape(-1, 2) + base
            if up in "ML":
                at = pts[0]
                out.append(at)
                if up == "M":
                    start, cmd = at, "l" if cmd == "m" else "L"
            else:
                if up in "ST":
                    pts = np.vstack((at if handle is None else 2 * at - handle, pts))
                p = np.vstack((at, pts))
                out.extend((1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t**2 * p[2] + t**3 * p[3] if len(p) == 4 else (1 - t) ** 2 * p[0] + 2 * (1 - t) * t * p[1] + t**2 * p[2])
                at, handle = pts[-1], pts[-2]
                continue
        handle = None
    return np.array(out)


def path_flags(paths: list[str | None]) -> dict[str, bool]:
    some = [p for p in paths if p]
    return {"contains_bends": any(len(re.findall("[LHVlhv]", p)) >= 2 for p in some), "contains_curves": any(re.search("[CQSTAcqsta]", p) for p in some)}


def _crossings(seg: np.ndarray, edge: np.ndarray, us: np.ndarray, vs: np.ndarray) -> tuple[int, np.ndarray]:
    """Proper crossings of segments of edges without a common end, and their acute angles."""
    angles, block = [], max(1, PAIRS // max(1, len(seg)))
    low, high = np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:])

    def turn(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])

    for a in range(0, len(seg), block):
        z = min(len(seg), a + block)
        meet = edge[a:z, None] < edge[None]
        for axis in (0, 1):  # boxes that don't overlap hold no crossing
            meet &= (low[a:z, None, axis] <= high[None, :, axis]) & (low[None, :, axis] <= high[a:z, None, axis])
        i, j = np.nonzero(meet)
        i += a
        p, q = edge[i], edge[j]
        ok = (us[p] != us[q]) & (us[p] != vs[q]) & (vs[p] != us[q]) & (vs[p] != vs[q])
        i, j = i[ok], j[ok]
        s, t = seg[i], seg[j]
        ok = (turn(s[:, :2], s[:, 2:], t[:, :2]) * turn(s[:, :2], s[:, 2:], t[:, 2:]) < 0) & (turn(t[:, :2], t[:, 2:], s[:, :2]) * turn(t[:, :2], t[:, 2:], s[:, 2:]) < 0)
        e, f = (x[:, 2:] - x[:, :2] for x in (s[ok], t[ok]))
        angles.append(np.degrees(np.arctan2(np.abs(e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]), np.abs((e * f).sum(axis=1)))))
    out = np.concatenate(angles) if angles else np.empty(0)
    return len(out), out


def score(n: int, us: np.ndarray, vs: np.ndarray, xy: np.ndarray, lines: dict[int, np.ndarray] | None = None) -> dict[str, float | None]:
    """All scores of a drawing: xy has the nodes' places, lines the points of edges that aren't straight (by number)."""
    m, out = len(us), dict.fromkeys(NAMES)
    if n == 0:
        return out
    low, span = xy.min(axis=0), xy.max(axis=0) - xy.min(axis=0)
    diag, long = float(np.hypot(*span)), float(span.max())
    out["aspect_ratio"] = float(span.min()) / long if long > 0 else 1.0
    deg = np.bincount(np.concatenate((us, vs)), minlength=n)
    gap = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    if n > 1 and diag > 0:
        out["node_resolution"] = float(gap[~np.eye(n, dtype=bool)].min()) / diag
    k = int(np.ceil(np.sqrt(n)))
    cell = np.minimum(k - 1, np.floor((xy - low) / np.where(span > 0, span, 1) * k)).astype(int)
    inside = np.bincount(cell[:, 0] * k + cell[:, 1], minlength=k * k)
    out["node_uniformity"] = 1 - float(np.abs(inside - n / k**2).sum()) / (2 * n * (1 - 1 / k**2)) if k > 1 else 1.0
    if m == 0:
        return out
    if lines:
        pieces = [np.asarray(lines[i], float) if i in lines else np.array([xy[us[i]], xy[vs[i]]]) for i in range(m)]
        seg = np.concatenate([np.hstack((p[:-1], p[1:])) for p in pieces])
        parts = np.array([len(p) - 1 for p in pieces])
    else:
        seg, parts = np.hstack((xy[us], xy[vs])), np.ones(m, np.int64)
    edge, last = np.repeat(np.arange(m), parts), np.cumsum(parts) - 1
    d = seg[:, 2:] - seg[:, :2]
    length = np.bincount(edge, np.hypot(d[:, 0], d[:, 1]), m)
    mean = float(length.mean())
    out["edge_length_deviation"] = 1 / (1 + float(np.abs(length - mean).mean()) / mean) if mean > 0 else 1.0
    tilt = np.degrees(np.arctan2(np.abs(d[:, 1]), np.abs(d[:, 0])))
    out["edge_orthogonality"] = 1 - float((np.bincount(edge, np.minimum(tilt, 90 - tilt), m) / np.bincount(edge, minlength=m)).mean()) / 45
    node, e = np.concatenate((us, vs)), np.concatenate((d[last - parts + 1], -d[last]))
    turn = np.degrees(np.arctan2(e[:, 1], e[:, 0]))
    by = np.lexsort((turn, node))
    node, turn = node[by], turn[by]
    begins = np.flatnonzero(np.diff(node, prepend=-1))
    fan = np.diff(np.append(begins, len(node)))
    step = np.diff(turn, append=0.0)
    step[begins + fan - 1] = turn[begins] + 360 - turn[begins + fan - 1]  # round to the first
    least, ideal = np.minimum.reduceat(step, begins), 360 / fan
    out["angular_resolution"] = 1 - float((np.abs(ideal - least) / ideal)[fan > 1].mean()) if (fan > 1).any() else None
    c, angles = _crossings(seg, edge, us, vs)
    most = m * (m - 1) / 2 - float((deg * (deg - 1)).sum()) / 2
    out["edge_crossings"] = max(0.0, 1 - c / most) if most > 0 else 1.0
    out["crossing_angle"] = 1 - float(np.abs(90 - angles).mean()) / 90 if c else 1.0
    other = np.ones((m, n), bool)
    other[np.arange(m), us] = other[np.arange(m), vs] = False
    middle, radius = (xy[us] + xy[vs]) / 2, gap[us, vs] / 2
    if m * (n - 2) > 0:
        near = np.hypot(*(xy[None] - middle[:, None]).transpose(2, 0, 1)) < radius[:, None] - 1e-9
        out["gabriel_ratio_nodes"] = 1 - float((near & other).sum()) / (m * (n - 2))
    else:
        out["gabriel_ratio_nodes"] = 1.0
    l2 = (d * d).sum(axis=1)
    along = (xy[None, :, 0] - seg[:, None, 0]) * d[:, None, 0] + (xy[None, :, 1] - seg[:, None, 1]) * d[:, None, 1]
    t = np.clip(along / np.where(l2 > 0, l2, 1)[:, None], 0, 1)
    far2 = (xy[None, :, 0] - seg[:, None, 0] - t * d[:, None, 0]) ** 2 + (xy[None, :, 1] - seg[:, None, 1] - t * d[:, None, 1]) ** 2
    hit = np.bincount(edge, ((far2 < (diag * 7.5 / 1000) ** 2) & other[edge]).any(axis=1), m) > 0
    out["node_edge_occlusion"] = 1 - float(hit.mean())
    adj = kernels.adjacency(n, us, vs)
    order = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), np.round(np.where(np.eye(n, dtype=bool), np.inf, gap), 9)), axis=1)
    nearest = np.zeros((n, n), bool)
    rows = np.repeat(np.arange(n), deg)
    nearest[rows, order[rows, np.concatenate([np.arange(x) for x in deg])]] = True
    out["neighbourhood_preservation"] = float((adj & nearest).sum()) / float((adj | nearest).sum())
    hops = kernels.all_distances(n, us, vs)
    if n > 1 and (hops >= 0).all():
        i, j = np.triu_indices(n, 1)
        by = np.lexsort((gap[i, j], hops[i, j]))
        dist = gap[i, j][by]
        total = float((dist**2).sum())
        out["kruskal_stress"] = 1 - float(np.sqrt(((dist - kernels.isotonic(dist)) ** 2).sum() / total)) if total > 0 else None
    return out
