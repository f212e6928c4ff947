"""Parsers of graph formats: the bytes of one file -> the graphs in it. They know nothing of Spark."""

from __future__ import annotations

import csv
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from xml.etree import ElementTree

Label = int | str


@dataclass
class Raw:
    """A graph as a file has it: labels, edges between labels, and what is drawn."""

    name: str
    nodes: list[Label] = field(default_factory=list)
    edges: list[tuple[Label, Label]] = field(default_factory=list)
    places: dict[Label, tuple[float, float]] = field(default_factory=dict)
    attrs: dict[Label, dict[str, str]] = field(default_factory=dict)
    paths: dict[int, str] = field(default_factory=dict)
    bends: dict[int, list[tuple[float, float]]] = field(default_factory=dict)


Parser = Callable[[str, bytes], Iterator[Raw]]
PARSERS: dict[str, Parser] = {}


class Skip(Exception):
    """A file without a usable graph; the message is the reason."""


def register(name: str) -> Callable[[Parser], Parser]:
    def add(f: Parser) -> Parser:
        if name in PARSERS:
            raise ValueError(f"format {name} exists")
        PARSERS[name] = f
        return f

    return add


def slug(text: str, most: int = 40) -> str:
    """Letters, digits, dots, dashes; others become one underscore; at most so many characters."""
    return re.sub(r"[^A-Za-z0-9.-]+", "_", text).strip("_")[:most]


def _stem(path: str) -> str:
    return PurePosixPath(path).name.split(".")[0]


def _label(text: str) -> Label:
    try:
        return int(text)
    except ValueError:
        return text


def _number(x: object) -> float | None:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def members(path: str, data: bytes, suffix: str | None = None) -> Iterator[tuple[str, bytes]]:
    """Files of a tar (of any compression) or zip archive in order of name; names that leave the archive are skipped."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if _inside(name) and not name.endswith("/") and (suffix is None or name.endswith(suffix)):
                    yield name, z.read(name)
        return
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
        for m in sorted(t.getmembers(), key=lambda m: m.name):
            if m.isfile() and _inside(m.name) and (suffix is None or m.name.endswith(suffix)) and (f := t.extractfile(m)):
                yield m.name, f.read()


def _inside(name: str) -> bool:
    p = PurePosixPath(name.replace("\\", "/"))
    return not p.is_absolute() and ".." not in p.parts and ":" not in name.partition("/")[0]


@register("graphml")
def graphml(path: str, data: bytes) -> Iterator[Raw]:
    """One GraphML document; x, y and path data by their keys' names."""
    root = ElementTree.fromstring(data)
    keys = {k.get("id"): k.get("attr.name") for k in root.iter() if _local(k.tag) == "key"}
    raw = Raw(_stem(path))
    for el in root.iter():
        kind = _local(el.tag)
        if kind not in ("node", "edge"):
            continue
        got = {keys.get(d.get("key"), d.get("key")): d.text or "" for d in el if _local(d.tag) == "data"}
        if kind == "node":
            node = _label(el.get("id", ""))
            raw.nodes.append(node)
            x, y = _number(got.get("x")), _number(got.get("y"))
            if x is not None and y is not None:
                raw.places[node] = (x, y)
            rest = {k: v for k, v in got.items() if k and k not in ("x", "y")}
            if rest:
                raw.attrs[node] = rest
        else:
            if got.get("path"):
                raw.paths[len(raw.edges)] = got["path"]
            raw.edges.append((_label(el.get("source", "")), _label(el.get("target", ""))))
    yield raw


@register("graphml_archive")
def graphml_archive(path: str, data: bytes) -> Iterator[Raw]:
    """All GraphML files of an archive; broken ones are skipped."""
    for name, inner in members(path, data, ".graphml"):
        try:
            yield from graphml(name, inner)
        except ElementTree.ParseError:
            continue


@register("edge_list")
def edge_list(path: str, data: bytes) -> Iterator[Raw]:
    """Two labels a line, apart by white space; lines that begin with # or % are notes."""
    raw = Raw(_stem(path))
    for line in data.decode("utf-8", "replace").splitlines():
        words = line.split()
        if len(words) >= 2 and words[0][0] not in "#%":
            raw.edges.append((_label(words[0]), _label(words[1])))
    yield raw


@register("csv_zip")
def csv_zip(path: str, data: bytes) -> Iterator[Raw]:
    """The edges.csv of a zip archive, with a header of source and target that may begin with #."""
    for _, inner in members(path, data, "edges.csv"):
        rows = csv.reader(io.StringIO(inner.decode("utf-8", "replace")))
        head = [h.strip().lstrip("#").strip() for h in next(rows, [])]
        if "source" not in head or "target" not in head:
            raise Skip("no_edge_columns")
        s, t = head.index("source"), head.index("target")
        yield Raw(_stem(path), edges=[(_label(r[s].strip()), _label(r[t].strip())) for r in rows if len(r) > max(s, t)])
        return
    raise Skip("no_edge_file")


@register("konect")
def konect(path: str, data: bytes) -> Iterator[Raw]:
    """The out.* member of a tar archive, an edge list."""
    for name, inner in members(path, data):
        if PurePosixPath(name).name.startswith("out."):
            for raw in edge_list(path, inner):
                raw.name = PurePosixPath(name).name[4:]
                yield raw
            return
    raise Skip("no_edge_file")


@register("geg")
def geg(path: str, data: bytes) -> Iterator[Raw]:
    """A drawn graph in JSON: nodes with id and position, edges with source, target and an SVG path. Its collection is the
    folder below geg/."""
    doc = json.loads(data)
    inner = doc.get("graph", doc) if isinstance(doc.get("graph", doc), dict) else doc
    folder = PurePosixPath(path).parent.name
    raw = Raw(f"gd_{folder.lower()}_{_stem(path)}" if folder.upper().startswith("GD") else _stem(path))
    for n in inner.get("nodes", []):
        node, at = n.get("id"), n.get("position")
        x, y = (n.get("x"), n.get("y")) if at is None else (at[:2] if isinstance(at, list) else (at.get("x"), at.get("y")))
        raw.nodes.append(node)
        if _number(x) is not None and _number(y) is not None:
            raw.places[node] = (float(x), float(y))
        rest = {k: str(v) for k, v in n.items() if k not in ("id", "position", "x", "y")}
        if rest:
            raw.attrs[node] = rest
    for e in inner.get("edges", inner.get("links", [])):
        if e.get("path"):
            raw.paths[len(raw.edges)] = e["path"]
        raw.edges.append((e.get("source"), e.get("target")))
    yield raw


@register("geg_archive")
def geg_archive(path: str, data: bytes) -> Iterator[Raw]:
    for name, inner in members(path, data, ".geg"):
        try:
            yield from geg(name, inner)
        except ValueError:
            continue


@register("adjacency_json")
def adjacency_json(path: str, data: bytes) -> Iterator[Raw]:
    """Records with an id and a list of neighbours for each node; an edge is taken from its smaller end."""
    doc = json.loads(data)
    for rec in doc if isinstance(doc, list) else doc.get("graphs", [doc]):
        near = rec.get("adjacencyList") or rec.get("adjacency_list") or []
        name = rec.get("graphId", rec.get("id", _stem(path)))
        yield Raw(f"hog_{name}", list(range(len(near))), [(u, v) for u, to in enumerate(near) for v in to if v > u])


@register("matpower")
def matpower(path: str, data: bytes) -> Iterator[Raw]:
    """The branch matrix of a power case: its first two columns."""
    block = re.search(r"mpc\.branch\s*=\s*\[(.*?)\]", data.decode("utf-8", "replace"), re.S)
    if not block:
        raise Skip("no_branch_block")
    edges = []
    for line in re.split(r"[;\n]", block[1]):
        words = line.split("%")[0].split()
        if len(words) >= 2 and all(_number(w) is not None for w in words[:2]):
            edges.append((int(float(words[0])), int(float(words[1]))))
    yield Raw(_stem(path), edges=edges)


# What a licence text must hold to be open, and what makes it closed all the same.
OPEN = (
    "cc0", "cc-0", "public domain", "public-domain", "waiver", "attribution 4.0 international", "attribution 3.0", "cc by 4.0", "cc by 3.0", "cc-by-4.0", "cc-by-3.0",
    "creativecommons.org/licenses/by/", "attribution-sharealike", "cc by-sa", "cc-by-sa", "creativecommons.org/licenses/by-sa/", "mit license", "apache license", "apache 2.0", "bsd license",
)
CLOSED = ("noncommercial", "non-commercial", "non commercial", "noderivatives", "no derivatives", "noderivative", "/by-nc/", "/by-nd/", "-nc-", "-nd-", " nc ", " nd ")


@register("cx")
def cx(path: str, data: bytes) -> Iterator[Raw]:
    """A CX1 or CX2 network: nodes with a place, and edges between them."""
    doc, raw = json.loads(data), Raw(_stem(path))
    ends = []
    for aspect in (a for a in doc if isinstance(a, dict)):
        for kind, key in (("nodes", "id"), ("cartesianLayout", "node")):
            for n in aspect.get(kind) or []:
                node, x, y = n.get(key, n.get("@id")), _number(n.get("x")), _number(n.get("y"))
                if _number(node) is not None and x is not None and y is not None:
                    raw.places[int(node)] = (x, y)
        ends += [(e.get("s"), e.get("t")) for e in aspect.get("edges") or []]
    if not raw.places:
        raise Skip("no_positions")
    raw.nodes = sorted(raw.places)
    for s, t in ends:
        if _number(s) is not None and _number(t) is not None and int(s) in raw.places and int(t) in raw.places:
            raw.edges.append((int(s), int(t)))
    yield raw


def cx_rights(data: bytes) -> tuple[str, str]:
    """(rights, rights holder) of a CX network, '' where it has none; the first of each counts."""
    out = {"rights": "", "rightsholder": ""}
    for aspect in json.loads(data):
        for a in (aspect.get("networkAttributes") or []) if isinstance(aspect, dict) else []:
            name = str(a.get("n") or "").strip().lower()
            if name in out and not out[name]:
                out[name] = str(a.get("v") or "").strip()
    return out["rights"], out["rightsholder"]


@register("pajek")
def pajek(path: str, data: bytes) -> Iterator[Raw]:
    """A Pajek network all of whose vertices have a place."""
    raw, section, expected = Raw(_stem(path)), "", None
    for line in (x.strip() for x in data.decode("utf-8", "replace").splitlines()):
        if not line or line[0] == "%":
            continue
        if line[0] == "*":
            words = line.lower().split()
            section = words[0]
            if section == "*vertices":
                if len(words) < 2 or not words[1].isdigit():
                    raise Skip("malformed_header")
                expected = int(words[1])
            continue
        if section == "*vertices":
            m = re.match(r'(\d+)\s*(?:"[^"]*"|\S+)?\s*(.*)', line)
            xy = re.findall(r"(?<![\w.])[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", m[2]) if m else []
            if len(xy) < 2:
                raise Skip("topology_only")
            raw.nodes.append(int(m[1]))
            raw.places[int(m[1])] = (float(xy[0]), float(xy[1]))
        elif section in ("*edges", "*arcs", "*edgeslist", "*arcslist"):
            words = line.split()
            if len(words) >= 2 and words[0].isdigit() and words[1].isdigit():
                to = words[1:] if section.endswith("list") else words[1:2]
                raw.edges += [(int(words[0]), int(w)) for w in to if w.isdigit()]
    if expected is None:
        raise Skip("no_vertices_section")
    if not raw.places:
        raise Skip("topology_only")
    yield raw


@register("pajek_archive")
def pajek_archive(path: str, data: bytes) -> Iterator[Raw]:
    for name, inner in members(path, data, ".net"):
        try:
            for raw in pajek(name, inner):
                raw.name = slug("_".join([*PurePosixPath(name).parts[1:-1], PurePosixPath(name).stem]), 200)
                yield raw
        except Skip:
            continue


@register("matrix_market")
def matrix_market(path: str, data: bytes) -> Iterator[Raw]:
    """A square, symmetric matrix in coordinate form; the diagonal isn't an edge."""
    lines = data.decode("utf-8", "replace").splitlines()
    if not lines or not lines[0].lower().startswith("%%matrixmarket") or "coordinate" not in lines[0].lower():
        raise Skip("not_coordinate")
    if "symmetric" not in lines[0].lower():
        raise Skip("not_symmetric")
    body = [x.split() for x in lines if x.strip() and x.lstrip()[0] != "%"]
    if not body or body[0][0] != body[0][1]:
        raise Skip("not_square")
    yield Raw(_stem(path), list(range(1, int(body[0][0]) + 1)), [(int(a), int(b)) for a, b, *_ in body[1:] if a != b])


@register("matrix_market_archive")
def matrix_market_archive(path: str, data: bytes) -> Iterator[Raw]:
    for name, inner in members(path, data, ".mtx"):
        yield from matrix_market(name, inner)


@register("tu_archive")
def tu_archive(path: str, data: bytes) -> Iterator[Raw]:
    """A TU collection: *_A.txt has pairs of nodes, line i of *_graph_indicator.txt the graph of node i, *_node_attributes.txt
    (if two numbers a line) its place. Pairs across graphs are dropped."""
    files = {PurePosixPath(n).name: d.decode("utf-8", "replace") for n, d in members(path, data, ".txt")}
    pick = lambda end: next((v for k, v in files.items() if k.endswith(end)), None)
    pairs, of = pick("_A.txt"), pick("_graph_indicator.txt")
    if pairs is None or of is None:
        raise Skip("missing_member")
    graph_of = {i: int(x) for i, x in enumerate(of.split(), 1)}
    raws = {g: Raw(f"{_stem(path).lower()}_graph{g:04d}") for g in sorted(set(graph_of.values()))}
    for node, g in graph_of.items():
        raws[g].nodes.append(node)
    places = [[_number(w) for w in line.split(",")] for line in (pick("_node_attributes.txt") or "").splitlines()]
    if len(places) == len(graph_of) and all(len(p) == 2 and None not in p for p in places):
        for node, p in enumerate(places, 1):
            raws[graph_of[node]].places[node] = (p[0], p[1])
    for line in pairs.splitlines():
        words = line.replace(",", " ").split()
        if len(words) >= 2:
            a, b = int(words[0]), int(words[1])
            if graph_of.get(a) is not None and graph_of.get(a) == graph_of.get(b):
                raws[graph_of[a]].edges.append((a, b))
    yield from raws.values()


@register("gpml")
def gpml(path: str, data: bytes) -> Iterator[Raw]:
    """A pathway: data nodes by their centres; interactions and lines from their first to their last referred node, the
    points between them without a reference are bends."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Skip("parse_error") from e
    raw = Raw(_stem(path))
    graphics = lambda el: next((c for c in el if _local(c.tag) == "Graphics"), None)
    for el in root.iter():
        kind, g = _local(el.tag), graphics(el)
        if kind == "DataNode" and g is not None and el.get("GraphId"):
            x, y = _number(g.get("CenterX")), _number(g.get("CenterY"))
            if x is not None and y is not None:
                node = el.get("GraphId")
                raw.nodes.append(node)
                raw.places[node] = (x, y)
                got = {to: g.get(at) for at, to in (("Width", "width"), ("Height", "height"), ("Color", "color"), ("FillColor", "fill"), ("ShapeType", "shape")) if g.get(at)}
                if got:
                    raw.attrs[node] = got
    for el in root.iter():
        kind, g = _local(el.tag), graphics(el)
        if kind in ("Interaction", "GraphicalLine") and g is not None:
            points = [p for p in g if _local(p.tag) == "Point"]
            refs = [p.get("GraphRef") for p in points if p.get("GraphRef")]
            if len(refs) >= 2 and refs[0] in raw.places and refs[-1] in raw.places and refs[0] != refs[-1]:
                free = [(_number(p.get("X")), _number(p.get("Y"))) for p in points if not p.get("GraphRef")]
                if kind == "Interaction" and free and all(None not in f for f in free):
                    raw.bends[len(raw.edges)] = free
                raw.edges.append((refs[0], refs[-1]))
    if not raw.places:
        raise Skip("no_positions")
    yield raw


def canonical(raw: Raw, drawn: bool) -> dict:
    """A graph with nodes 0..n-1, loops out, parallel edges merged (the first keeps its path and bends).

    Topology keeps the order of first appearance; a drawing sorts nodes by their labels as text and keeps labels,
    places, attributes and the geometry of edges.
    """
    order = dict.fromkeys(raw.nodes) | dict.fromkeys(x for e in raw.edges for x in e)
    names = sorted(order, key=str) if drawn else list(order)
    at, pairs = {x: i for i, x in enumerate(names)}, {}
    for i, (a, b) in enumerate(raw.edges):
        if a != b:
            pairs.setdefault((min(at[a], at[b]), max(at[a], at[b])), i)
    edges = sorted(pairs)
    out = {"name": raw.name, "n": len(names), "us": [e[0] for e in edges], "vs": [e[1] for e in edges]}
    if drawn:
        out |= {
            "orig_ids": [str(x) for x in names], "xs": [raw.places.get(x, (None, None))[0] for x in names], "ys": [raw.places.get(x, (None, None))[1] for x in names],
            "attrs": [raw.attrs.get(x, {}) for x in names], "paths": [raw.paths.get(pairs[e]) for e in edges],
            "bends": [[{"x": x, "y": y} for x, y in raw.bends.get(pairs[e], [])] for e in edges],
        }
    return out
