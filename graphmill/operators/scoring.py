"""Layout, standard form and all scores of packed graphs in one pass over the data; drawings never leave the task."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches, layouts, paths, scores
from ..functions.guard import TimedOut, guarded
from ..seeds import seed
from .corpus import spread
from .drawings import bends_path


def scored(edges: DataFrame, at: DataFrame, names: list[str] = scores.NAMES) -> DataFrame:
    """(graph_id, layout, names): scores of given drawings with straight edges, by the kernel."""
    places = at.groupBy("graph_id", "layout").agg(F.array_sort(F.collect_list(F.struct("node", "x", "y"))).alias("p"))
    lines = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("e"))
    df = places.join(lines, "graph_id").select("graph_id", "layout", F.col("p.node").alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    df = spread(df, "graph_id", "layout")
    schema = T.StructType([df.schema["graph_id"], df.schema["layout"], *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                node = np.asarray(r.node)
                us, vs = np.searchsorted(node, r.u), np.searchsorted(node, r.v)
                top = len(node) - 1
                ok = (node[np.minimum(us, top)] == r.u) & (node[np.minimum(vs, top)] == r.v)
                got = scores.score(len(node), us[ok], vs[ok], np.column_stack((r.x, r.y)))
                rows.append((r.graph_id, r.layout, *(got[c] for c in names)))
            yield pd.DataFrame(rows, columns=schema.names)

    return df.mapInPandas(run, schema)


class Drawing(NamedTuple):
    """A drawing in standard form: places, and for edges that aren't straight their points and path texts (by number)."""

    xy: np.ndarray
    lines: dict[int, np.ndarray]
    paths: dict[int, str]
    flags: dict[str, bool]


def _given(n: int, us: np.ndarray, vs: np.ndarray, given: object) -> Drawing:
    """The drawing that came with the graph. Paths take the places' affine map, so curves stay curves, and are snapped to the
    nodes; one that can't be read becomes straight."""
    xs, ys, ways = (getattr(given, c, None) for c in ("xs", "ys", "paths"))
    place = None if xs is None or ys is None or not len(xs) else np.array([[np.nan if v is None else v for v in c] for c in (xs, ys)], float).T
    xy, _ = layouts.lay_out("curated", n, us, vs, xy=place) if n > 1 else (np.zeros((n, 2)), {})
    low, high = xy.min(axis=0), xy.max(axis=0)
    diag = float(np.hypot(*(high - low)))
    mid, scale = (low + high) / 2, 1000 / diag if diag > 0 else 1.0
    done, lines, texts = (xy - mid) * scale, {}, {}
    for i, (u, v) in enumerate(zip(us.tolist(), vs.tolist(), strict=True)):
        way = ways[i] if ways is not None and i < len(ways) else None
        if way:
            try:
                moved = paths.snapped_path(paths.moved_path(way, (float(mid[0]), float(mid[1])), scale), tuple(done[u]), tuple(done[v]))
                lines[i], texts[i] = scores.polyline(moved), moved
            except (ValueError, IndexError):
                continue
    return Drawing(done, lines, texts, scores.path_flags(list(texts.values())))


def drawing(layout: str, graph: object, n: int, us: np.ndarray, vs: np.ndarray, root: int = 1, limit_s: float | None = None, given: object = None) -> Drawing:
    """One graph under one layout. Only curated looks at the geometry that came with the graph."""
    if layout == "curated":
        return _given(n, us, vs, given)
    work = lambda: layouts.lay_out(layout, n, us, vs, seed=seed(root, layout, graph))
    xy, bends = layouts.standardised(*(work() if limit_s is None else guarded(work, limit_s)), us)  # type: ignore[misc]
    lines = {i: np.vstack((xy[us[i]], b, xy[vs[i]])) for i, b in bends.items() if len(b)}
    return Drawing(xy, lines, {i: _path(p) for i, p in lines.items()}, {"contains_bends": bool(lines), "contains_curves": False})


def _path(points: np.ndarray) -> str:
    return "M " + " L ".join(f"{x:.6g},{y:.6g}" for x, y in points.tolist())


def one_drawing(layout: str, graph: object, n: int, us: np.ndarray, vs: np.ndarray, root: int = 1, limit_s: float | None = None, given: object = None, geometry: bool = False, scored: bool = True) -> dict:
    """Outcome (ok, not_applicable, timeout, failed), scores and flags of one graph under one layout; with geometry also xs, ys
    and paths, where a straight edge's path is its chord."""
    try:
        d = drawing(layout, graph, n, us, vs, root, limit_s, given)
        out = {"outcome": "ok", **(scores.score(n, us, vs, d.xy, d.lines) if scored else {}), **d.flags}
        if geometry:
            out |= {"xs": d.xy[:, 0].tolist(), "ys": d.xy[:, 1].tolist(), "paths": [d.paths.get(i) or _path(d.xy[[u, v]]) for i, (u, v) in enumerate(zip(us, vs, strict=True))]}
        return out
    except layouts.NotApplicable:
        return {"outcome": "not_applicable"}
    except TimedOut:
        return {"outcome": "timeout"}
    except Exception:  # noqa: BLE001
        return {"outcome": "failed"}


#: Geometry that a packed row may have beside its edges.
GIVEN = ("xs", "ys", "paths", "bends")
GEOMETRY = "xs array<double>, ys array<double>, paths array<string>"


def _ways() -> Column:
    """The path of each edge: its own, or one through its bends."""
    at = lambda i: F.struct(F.element_at("xs", i + 1).alias("x"), F.element_at("ys", i + 1).alias("y"))
    own = lambda e: F.coalesce(e["paths"], bends_path(at(e["us"]), e["bends"], at(e["vs"])))
    return F.when(F.col("xs").isNotNull() & F.col("bends").isNotNull(), F.transform(F.arrays_zip("us", "vs", "paths", "bends"), own)).otherwise(F.col("paths"))


def _open(packed: DataFrame, names: list[str], done: DataFrame | None = None, flags: bool = False, first: DataFrame | None = None) -> DataFrame:
    """packed with the list of its open layouts (__open), spread; graphs without any are left out."""
    wanted = F.array(*map(F.lit, names))
    if flags:
        needs = {k: F.col(v) for k, v in layouts.NEEDS.items()} | {"curated": F.col("category") == "graphs_with_drawings"}
        needs = {k: v for k, v in needs.items() if k != "curated" or "category" in packed.columns}
        wanted = F.array_compact(F.array(*(F.when(needs[x], F.lit(x)) if x in needs else F.lit(x) for x in names)))
    if done is not None:
        have = done.groupBy(F.col("graph_id").alias("__g")).agg(F.collect_set("layout").alias("__have"))
        packed = packed.join(have, F.col("graph_id") == F.col("__g"), "left").drop("__g")
        wanted = F.array_except(wanted, F.coalesce("__have", F.array().cast("array<string>")))
    if "bends" in packed.columns:
        packed = packed.withColumn("paths", _ways()).drop("bends")
    drawn = [c for c in GIVEN if c in packed.columns]
    rows = packed.withColumn("__open", wanted).filter(F.size("__open") > 0).select("graph_id", "n", "us", "vs", *drawn, "__open")
    if first is None:
        return spread(rows, "graph_id")
    ids = first.select(F.col("graph_id").alias("__g"), F.lit(True).alias("__first")).distinct()
    return spread(rows.join(ids, F.col("graph_id") == F.col("__g"), "left"), "graph_id").sortWithinPartitions(F.desc_nulls_last("__first"), "graph_id")


def _tasks(packed: DataFrame, names: list[str], done: DataFrame | None = None, flags: bool = False, first: DataFrame | None = None) -> DataFrame:
    """packed with a row for each of its open layouts. Graphs meet the layouts within the task, so their edges travel once."""
    rows = _open(packed, names, done, flags, first)
    return rows.select("graph_id", F.explode("__open").alias("layout"), "n", "us", "vs", *(c for c in GIVEN if c in rows.columns))


#: Drawings that are handed on together.
ROWS = 5_000


def _chunks(rows: list) -> Iterator[tuple[list, batches.Chunk | None]]:
    """rows in parts: graphs of one size with the same open layouts as a chunk; those that batches can't take without one."""
    alike: dict[tuple, list] = {}
    for r in rows:
        us, vs = np.asarray(r.us, np.int64), np.asarray(r.vs, np.int64)
        plain = r.n > 2 and len(us) > 0 and bool((us != vs).all()) and len(np.unique(np.minimum(us, vs) * int(r.n) + np.maximum(us, vs))) == len(us)
        alike.setdefault((int(r.n), tuple(r.open)) if plain else None, []).append((r, us, vs))
    for key, part in alike.items():
        step = len(part) if key is None else max(1, batches.PAIRS // key[0] ** 2)
        for i in range(0, len(part), step):
            few = part[i : i + step]
            yield [r for r, _, _ in few], None if key is None else batches.Chunk(key[0], [(us, vs) for _, us, vs in few])


#: What is told of a drawing, a row for each; a score is NaN where a drawing has none.
TOLD = np.dtype([("outcome", object), *((c, float) for c in scores.NAMES), *((c, object) for c in scores.FLAGS)])


def _scored_chunk(rows: list, c: batches.Chunk, layout: str, root: int) -> np.ndarray:
    """one_drawing of each row under one layout, as TOLD."""
    out = np.empty(len(rows), TOLD)
    lines: list | np.ndarray | None = None
    if layout == "arc-bfs":
        xy, lines = batches.arc_bfs(c)
    elif layout in batches.LAYOUTS:
        xy = batches.standardised(batches.LAYOUTS[layout](c, [seed(root, layout, r.graph_id) for r in rows]))
    else:
        found: list[Drawing | None] = []
        outcomes = []
        for r, (us, vs) in zip(rows, c.graphs, strict=True):
            try:
                found.append(drawing(layout, r.graph_id, c.n, us, vs, root, None, r))
                outcomes.append("ok")
            except layouts.NotApplicable:
                found.append(None)
                outcomes.append("not_applicable")
            except Exception:  # noqa: BLE001
                found.append(None)
                outcomes.append("failed")
        some = [d for d in found if d is not None]
        if len(some) < len(found):
            c = c.part([i for i, d in enumerate(found) if d is not None]) if some else c
        out["outcome"] = outcomes
        for f in scores.FLAGS:
            out[f] = [None if d is None else d.flags[f] for d in found]
        for name in scores.NAMES:
            out[name] = np.nan
        if some:
            drawn = np.array([d is not None for d in found])
            for name, got in batches.scores(c, np.array([d.xy for d in some]), [d.lines for d in some] if any(d.lines for d in some) else None).items():
                out[name][drawn] = got
        return out
    out["outcome"], out["contains_bends"], out["contains_curves"] = "ok", lines is not None, False
    for name, got in batches.scores(c, xy, lines).items():
        out[name] = got
    return out


def _scored(tasks: DataFrame, fields: list[T.StructField], root: int) -> DataFrame:
    """_drawings without geometry or time limits: graphs of one size are laid out and scored together."""
    schema = T.StructType([tasks.schema["graph_id"], T.StructField("layout", T.StringType()), *fields])

    def table(ids: list, names: list[str], told: list[np.ndarray]) -> pd.DataFrame:
        got = np.concatenate(told)
        return pd.DataFrame({schema.names[0]: ids, "layout": names, **{c: got[c] for c in schema.names[2:]}})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, names, told = [], [], []
        for b in parts:
            for rows, c in _chunks(list(b.itertuples(index=False))):
                for layout in rows[0].open if c is not None else ():
                    try:
                        told.append(_scored_chunk(rows, c, layout, root))
                    except Exception:  # noqa: BLE001
                        told.append(np.array([_alone(r, layout, root) for r in rows], TOLD))
                    ids += [r.graph_id for r in rows]
                    names += [layout] * len(rows)
                if c is None:
                    each = [(r, layout) for r in rows for layout in r.open]
                    told.append(np.array([_alone(r, layout, root) for r, layout in each], TOLD))
                    ids += [r.graph_id for r, _ in each]
                    names += [layout for _, layout in each]
                if len(ids) >= ROWS:
                    yield table(ids, names, told)
                    ids, names, told = [], [], []
        if ids:
            yield table(ids, names, told)

    return tasks.withColumnRenamed("__open", "open").mapInPandas(run, schema)


def _alone(r: object, layout: str, root: int) -> tuple:
    got = one_drawing(layout, r.graph_id, int(r.n), np.asarray(r.us, np.int64), np.asarray(r.vs, np.int64), root, None, r)  # type: ignore[attr-defined]
    return got["outcome"], *(got.get(c) for c in (*scores.NAMES, *scores.FLAGS))


def _drawings(tasks: DataFrame, fields: list[T.StructField], root: int, limit_s: float | dict[str, float] | None, **more: bool) -> DataFrame:
    schema = T.StructType([tasks.schema["graph_id"], tasks.schema["layout"], *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                limit = limit_s.get(r.layout) if isinstance(limit_s, dict) else limit_s
                got = one_drawing(r.layout, r.graph_id, int(r.n), np.asarray(r.us, np.int64), np.asarray(r.vs, np.int64), root, limit, r, **more)
                rows.append((r.graph_id, r.layout, *(got.get(c) for c in schema.names[2:])))
            yield pd.DataFrame(rows, columns=schema.names)

    return tasks.mapInPandas(run, schema)


def laid_out_and_scored(packed: DataFrame, names: list[str], root: int = 1, done: DataFrame | None = None, flags: bool = False, limit_s: float | dict[str, float] | None = None, geometry: bool = False, first: DataFrame | None = None) -> DataFrame:
    """(graph_id, layout, outcome, scores, contains_bends, contains_curves) for every graph and layout.

    Pairs in done(graph_id, layout) are left out before anything is computed. With flags, packed has the manifest's
    is_planar and is_tree (and may have its category), and pairs that these rule out are dropped before the kernel. Columns xs,
    ys, paths and bends, if there are any, are the drawing of the layout curated. With limit_s (seconds, or seconds by
    layout), layouts run in a child process and are given up after so long. With geometry, xs, ys and paths come too. Graphs in
    first(graph_id) come before others in every task.
    """
    fields = [T.StructField("outcome", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in scores.NAMES), *(T.StructField(c, T.BooleanType()) for c in scores.FLAGS)]
    fields += T._parse_datatype_string(GEOMETRY).fields if geometry else []
    if limit_s is None and first is None and not geometry:
        return _scored(_open(packed, names, done, flags), fields, root)
    return _drawings(_tasks(packed, names, done, flags, first), fields, root, limit_s, geometry=geometry)


def laid_out(packed: DataFrame, names: list[str], root: int = 1) -> DataFrame:
    """(graph_id, layout, outcome, xs, ys, paths): drawings in standard form; the path of a straight edge is its chord."""
    return _drawings(_tasks(packed, names), T._parse_datatype_string("outcome string, " + GEOMETRY).fields, root, None, geometry=True, scored=False)
