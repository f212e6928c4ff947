"""The formats the other way round: one graph -> the bytes of a file. Labels of nodes begin at FIRST[format].

Every writer has the parser of the same name in formats, which gives the graph back.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import paths

Writer = Callable[[str, int, list[int], list[int]], bytes]
WRITERS: dict[str, Writer] = {}
#: Bytes of files that are handed on together.
BLOCK_BYTES = 4_000_000
#: The label of a format's first node, 0 if it isn't named.
FIRST = {"matrix_market": 1, "matrix_market_archive": 1, "pajek": 1, "pajek_archive": 1, "tu_archive": 1, "matpower": 1}


def register(name: str) -> Callable[[Writer], Writer]:
    def add(f: Writer) -> Writer:
        if name in WRITERS:
            raise ValueError(f"writer {name} exists")
        WRITERS[name] = f
        return f

    return add


def _circle(n: int) -> list[tuple[float, float]]:
    a = 2 * np.pi * np.arange(n) / max(1, n)
    return list(zip(np.round(np.cos(a), 6).tolist(), np.round(np.sin(a), 6).tolist(), strict=True))


def _tar(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def _lines(rows: list[str]) -> bytes:
    return "".join(r + "\n" for r in rows).encode()


@register("graphml")
def graphml(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return paths.to_graphml(n, us, vs).encode()


@register("graphml_archive")
def graphml_archive(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _tar({f"graphs/{name}.graphml": graphml(name, n, us, vs)})


@register("geg")
def geg(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return paths.to_geg(n, us, vs, _circle(n)).encode()


@register("geg_archive")
def geg_archive(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _zip({f"geg/{name}.geg": geg(name, n, us, vs)})


@register("edge_list")
def edge_list(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _lines(["# source target", *(f"{u} {v}" for u, v in zip(us, vs, strict=True))])


@register("csv_zip")
def csv_zip(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _zip({"edges.csv": _lines(["# source, target", *(f"{u}, {v}" for u, v in zip(us, vs, strict=True))])})


@register("konect")
def konect(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _tar({f"{name}/out.{name}": _lines(["% sym unweighted", *(f"{u} {v}" for u, v in zip(us, vs, strict=True))])})


@register("adjacency_json")
def adjacency_json(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    near: list[list[int]] = [[] for _ in range(n)]
    for u, v in zip(us, vs, strict=True):
        near[u].append(v)
        near[v].append(u)
    return json.dumps([{"graphId": name, "adjacencyList": near}]).encode()


@register("matpower")
def matpower(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _lines([f"function mpc = case_{n}", "mpc.branch = [", *(f"  {u + 1} {v + 1} 0.01 0.1; % line" for u, v in zip(us, vs, strict=True)), "];"])


@register("cx")
def cx(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    places = [{"node": i, "x": x, "y": y} for i, (x, y) in enumerate(_circle(n))]
    return json.dumps([{"nodes": [{"@id": i} for i in range(n)]}, {"cartesianLayout": places}, {"edges": [{"s": u, "t": v} for u, v in zip(us, vs, strict=True)]}]).encode()


@register("pajek")
def pajek(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _lines([f"*Vertices {n}", *(f'{i} "node {i}" {x} {y} 0.5' for i, (x, y) in enumerate(_circle(n), 1)), "*Edges", *(f"{u + 1} {v + 1} 1" for u, v in zip(us, vs, strict=True))])


@register("pajek_archive")
def pajek_archive(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _zip({f"nets/{name}.net": pajek(name, n, us, vs)})


@register("matrix_market")
def matrix_market(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _lines(["%%MatrixMarket matrix coordinate pattern symmetric", f"{n} {n} {len(us)}", *(f"{v + 1} {u + 1}" for u, v in zip(us, vs, strict=True))])


@register("matrix_market_archive")
def matrix_market_archive(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    return _tar({f"{name}/{name}.mtx": matrix_market(name, n, us, vs)})


@register("tu_archive")
def tu_archive(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    both = [p for u, v in zip(us, vs, strict=True) for p in ((u + 1, v + 1), (v + 1, u + 1))]
    return _zip({"X/X_A.txt": _lines([f"{a}, {b}" for a, b in both]), "X/X_graph_indicator.txt": _lines(["1"] * n), "X/X_node_attributes.txt": _lines([f"{x},{y}" for x, y in _circle(n)])})


@register("gpml")
def gpml(name: str, n: int, us: list[int], vs: list[int]) -> bytes:
    nodes = [f'<DataNode GraphId="{i}"><Graphics CenterX="{x}" CenterY="{y}"/></DataNode>' for i, (x, y) in enumerate(_circle(n))]
    lines = [f'<Interaction><Graphics><Point X="0" Y="0" GraphRef="{u}"/><Point X="0" Y="0" GraphRef="{v}"/></Graphics></Interaction>' for u, v in zip(us, vs, strict=True)]
    return ('<Pathway xmlns="http://pathvisio.org/GPML/2013a">' + "".join(nodes + lines) + "</Pathway>").encode()


def files(batches: Iterator[pd.DataFrame], fmt: str) -> Iterator[tuple[str, bytes]]:
    """(path, content) of batches of packed rows, each file made when it is asked for."""
    for b in batches:
        for r in b.itertuples(index=False):
            yield f"{r.graph_id}.dat", WRITERS[fmt](str(r.graph_id), int(r.n), [int(u) for u in r.us], [int(v) for v in r.vs])


def encoded(packed: DataFrame, fmt: str) -> DataFrame:
    """(path, content) of packed graphs, one file each, named by graph_id; for readers.parse_files or any sink of bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for f in files(batches, fmt):
            rows.append(f)
            held += len(f[1])
            if held >= BLOCK_BYTES:
                yield pd.DataFrame(rows, columns=["path", "content"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "content"])

    return packed.select("graph_id", "n", "us", "vs").mapInPandas(run, "path string, content binary")
