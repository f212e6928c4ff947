"""Text forms of edge geometry: affine maps of SVG paths, spline strings, TGLF."""

from __future__ import annotations

import re

import numpy as np

from .scores import _WORD

Point = tuple[float, float]
_PAIRS = {"M": 1, "L": 1, "T": 1, "Q": 2, "S": 2, "C": 3}


def moved_path(path: str, centre: Point, scale: float) -> str:
    """path after (x, y) -> ((x, y) - centre) * scale. Curves stay curves: their handles move along. Relative commands are
    only scaled, and radii of arcs too."""
    words, out, i, cmd = _WORD.findall(path), [], 0, ""
    text = lambda v: f"{v:.6g}"
    first = True
    while i < len(words):
        if words[i].isalpha():
            cmd, i = words[i], i + 1
            out.append(cmd)
            if cmd in "Zz":
                continue
        up, shift = cmd.upper(), cmd.isupper() or (cmd == "m" and first)
        at = lambda v, axis: text((float(v) - (centre[axis] if shift else 0)) * scale)  # noqa: E731, B023
        if up in _PAIRS:
            k = 2 * _PAIRS[up]
            out += [f"{at(words[j], 0)},{at(words[j + 1], 1)}" for j in range(i, i + k, 2)]
        elif up in "HV":
            k = 1
            out.append(at(words[i], 0 if up == "H" else 1))
        elif up == "A":
            k = 7
            out += [text(float(words[i]) * scale), text(float(words[i + 1]) * scale), *words[i + 2 : i + 5], f"{at(words[i + 5], 0)},{at(words[i + 6], 1)}"]
        else:
            raise ValueError(f"path command {cmd}")
        first, i = False, i + k
    return " ".join(out)


def snapped_path(path: str, start: Point, end: Point) -> str:
    """path with its first point at start and its last at end, where these are absolute coordinates."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    pair = rf"({number})\s*,?\s*({number})"
    text = lambda p: f"{p[0]:.6g},{p[1]:.6g}"
    path = re.sub(rf"^(\s*M\s*){pair}", lambda m: m[1] + text(start), path, count=1)
    last = [m[0] for m in re.finditer(r"[A-Za-z](?![0-9])", path) if m[0] not in "eE"]
    if last and last[-1].isupper() and last[-1] not in "HVZ":
        path = re.sub(rf"{pair}\s*$", lambda m: text(end), path, count=1)
    return path


def spline_points(text: str) -> list[Point]:
    """Points of a spline string "[s,x,y] [e,x,y] x,y x,y ...": a start anchor comes first, an end anchor last."""
    first, last, rest = [], [], []
    for word in text.replace("\\\n", "").split():
        parts = word.split(",")
        where = rest
        if parts[0] in ("s", "e"):
            where = first if parts[0] == "s" else last
            parts = parts[1:]
        where.append((float(parts[0]), float(parts[1])))
    return first + rest + last


def without_anchors(points: list[Point], start: Point, end: Point, near: float = 1e-3) -> list[Point]:
    """points less those at the ends that lie on start or end."""
    out = list(points)
    while out and np.hypot(out[0][0] - start[0], out[0][1] - start[1]) <= near:
        out.pop(0)
    while out and np.hypot(out[-1][0] - end[0], out[-1][1] - end[1]) <= near:
        out.pop()
    return out


def to_tglf(sizes: list[Point], edges: list[tuple[int, int]], places: list[Point] | None = None) -> str:
    """Nodes "id x y w h", a line "#", edges "u v"."""
    at = places or [(0.0, 0.0)] * len(sizes)
    rows = [f"{i} {x:g} {y:g} {w:g} {h:g}" for i, ((x, y), (w, h)) in enumerate(zip(at, sizes, strict=True))]
    return "\n".join([*rows, "#", *(f"{u} {v}" for u, v in edges)]) + "\n"


def from_tglf(text: str) -> tuple[dict[int, Point], dict[tuple[int, int], list[Point]]]:
    """Places of nodes, and bends of edges ("u v x y x y ..."), less those on the edge's ends."""
    head, _, tail = text.partition("#")
    places = {int(w[0]): (float(w[1]), float(w[2])) for w in (line.split() for line in head.splitlines()) if len(w) >= 3}
    bends = {}
    for w in (line.split() for line in tail.splitlines()):
        if len(w) >= 2 and w[0].isdigit():
            u, v, xy = int(w[0]), int(w[1]), [float(x) for x in w[2:]]
            bends[u, v] = without_anchors(list(zip(xy[::2], xy[1::2], strict=False)), places[u], places[v])
    return places, bends


def to_graphml(n: int, us: list[int], vs: list[int], xy: list[Point] | None = None, paths: list[str | None] | None = None) -> str:
    """A GraphML document of a graph, with places and paths if there are any."""
    from xml.sax.saxutils import escape

    keys = ['<key id="x" for="node" attr.name="x" attr.type="double"/>', '<key id="y" for="node" attr.name="y" attr.type="double"/>'] * bool(xy) + ['<key id="path" for="edge" attr.name="path" attr.type="string"/>'] * bool(paths)
    nodes = [f'<node id="{i}">' + (f'<data key="x">{xy[i][0]!r}</data><data key="y">{xy[i][1]!r}</data>' if xy else "") + "</node>" for i in range(n)]
    lines = [f'<edge source="{u}" target="{v}">' + (f'<data key="path">{escape(paths[i])}</data>' if paths and paths[i] else "") + "</edge>" for i, (u, v) in enumerate(zip(us, vs, strict=True))]
    return '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(keys) + '<graph edgedefault="undirected">' + "".join(nodes + lines) + "</graph></graphml>"


def to_geg(n: int, us: list[int], vs: list[int], xy: list[Point], paths: list[str | None] | None = None) -> str:
    """A drawn graph in JSON."""
    import json

    edges = [{"source": u, "target": v} | ({"path": paths[i]} if paths and paths[i] else {}) for i, (u, v) in enumerate(zip(us, vs, strict=True))]
    return json.dumps({"nodes": [{"id": i, "position": [xy[i][0], xy[i][1]]} for i in range(n)], "edges": edges}, separators=(",", ":"))
