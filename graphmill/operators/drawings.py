"""Drawings as relations: positions(graph_id, layout, node, x, y) beside edges(graph_id, u, v).

Every score is in [0, 1], higher is better, null where a drawing has nothing to score. Straight edges; curved ones
are sampled to polylines by functions.scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..seeds import seed_column, unit

KEY = ["graph_id", "layout"]
#: The diagonal of a standardised drawing, and the radius of a node in it.
DIAGONAL, RADIUS = 1000.0, 7.5


def circular(nodes: DataFrame) -> DataFrame:
    """Nodes on the unit circle in their order."""
    w = Window.partitionBy("graph_id")
    angle = 2 * math.pi * (F.row_number().over(w.orderBy("node")) - 1) / F.count("*").over(w)
    return nodes.withColumn("a", angle).select("graph_id", F.lit("circular").alias("layout"), "node", F.cos("a").alias("x"), F.sin("a").alias("y"))


def random(nodes: DataFrame, root: int = 1) -> DataFrame:
    """Places from md5 of the seed (of root, layout and graph) and the node: the same for every order and partitioning, and in
    the kernel of that name, for nodes numbered from 0."""
    digest = F.md5(F.concat_ws("|", seed_column(root, "random", F.col("graph_id")).cast("string"), F.col("node").cast("string")))
    return nodes.select("graph_id", F.lit("random").alias("layout"), "node", unit(digest, 1).alias("x"), unit(digest, 7).alias("y"))


def from_vectors(nodes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Node i at coordinates 2k and 2k + 1 of vector i; nodes without a vector are left out."""
    v = vectors.select(F.col("vec_id").alias("node"), F.element_at("embedding", 2 * k + 1).cast("double").alias("x"), F.element_at("embedding", 2 * k + 2).cast("double").alias("y"))
    return nodes.join(v, "node").select("graph_id", F.lit(f"emb_{k}").alias("layout"), "node", "x", "y")


def boxes(at: DataFrame) -> DataFrame:
    """(graph_id, layout, x0, y0, w, h, diag, n) of each drawing."""
    return at.groupBy(*KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count("*").alias("n")).withColumn("diag", F.hypot("w", "h"))


def standardise(at: DataFrame) -> DataFrame:
    """Positions moved to the centre of their box and scaled to a diagonal of 1000; a drawing in one point is only
    moved. Doing it again changes nothing."""
    w = Window.partitionBy(*KEY)
    cx, cy = (F.min("x").over(w) + F.max("x").over(w)) / 2, (F.min("y").over(w) + F.max("y").over(w)) / 2
    diag = F.hypot(F.max("x").over(w) - F.min("x").over(w), F.max("y").over(w) - F.min("y").over(w))
    df = at.withColumns({"cx": cx, "cy": cy, "k": F.when(diag > 0, DIAGONAL / diag).otherwise(F.lit(1.0))})
    return df.select(*KEY, "node", ((F.col("x") - F.col("cx")) * F.col("k")).alias("x"), ((F.col("y") - F.col("cy")) * F.col("k")).alias("y"))


def chords(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(graph_id, layout, u, v, x1, y1, x2, y2): edges with the places of their ends. Places travel as one map for each
    drawing, so edges meet them in one join on graph_id."""
    maps = at.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("x", "y")))).alias("p"))
    e = edges.join(maps, "graph_id").select(*KEY, "u", "v", F.element_at("p", F.col("u")).alias("a"), F.element_at("p", F.col("v")).alias("b"))
    return e.filter("a IS NOT NULL AND b IS NOT NULL").select(*KEY, "u", "v", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def _length() -> Column:
    return F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def aspect_ratio(at: DataFrame) -> DataFrame:
    """The box's shorter by its longer side; 1 for a point."""
    long = F.greatest("w", "h")
    return boxes(at).select(*KEY, F.when(long > 0, F.least("w", "h") / long).otherwise(F.lit(1.0)).alias("aspect_ratio"))


def edge_length_deviation(edges: DataFrame, at: DataFrame) -> DataFrame:
    """1 / (1 + mean deviation of lengths from their mean, by the mean); 1 if all lengths are 0."""
    lengths = chords(edges, at).groupBy(*KEY).agg(F.collect_list(_length()).alias("l"), F.avg(_length()).alias("m"))
    off = F.aggregate("l", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("m"))) / F.size("l")
    return lengths.select(*KEY, F.when(F.col("m") > 0, 1 / (1 + off / F.col("m"))).otherwise(F.lit(1.0)).alias("edge_length_deviation"))


def edge_orthogonality(edges: DataFrame, at: DataFrame) -> DataFrame:
    """1 - mean of the angle to the nearer axis by 45 degrees."""
    angle = F.degrees(F.atan2(F.abs(F.col("y2") - F.col("y1")), F.abs(F.col("x2") - F.col("x1"))))
    return chords(edges, at).groupBy(*KEY).agg((1 - F.avg(F.least(angle, 90 - angle) / 45)).alias("edge_orthogonality"))


def angular_resolution(edges: DataFrame, at: DataFrame) -> DataFrame:
    """1 - mean, over nodes of two edges or more, of how far the least angle falls short of 360 / degree, by that."""
    c = chords(edges, at)
    ends = c.select(*KEY, F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("a")),
        F.struct(F.col("v").alias("node"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("a")),
    )).alias("s")).select(*KEY, "s.node", F.degrees("s.a").alias("a"))
    fans = ends.groupBy(*KEY, "node").agg(F.array_sort(F.collect_list("a")).alias("a")).filter(F.size("a") > 1)
    gaps = F.zip_with(F.slice("a", 2, F.size("a") - 1), F.slice("a", 1, F.size("a") - 1), lambda x, y: x - y)
    least = F.least(F.array_min(gaps), F.element_at("a", 1) + 360 - F.element_at("a", -1))
    ideal = 360 / F.size("a")
    return fans.groupBy(*KEY).agg((1 - F.avg(F.abs(ideal - least) / ideal)).alias("angular_resolution"))


def crossings(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(graph_id, layout, u1, v1, u2, v2, angle): pairs of edges without a common end whose chords cross properly, and
    their acute angle in degrees.

    A drawing's chords are one array, in order, and each chord looks through those behind it: pairs are made and dropped
    within the row and never travel.
    """
    fields = ("u", "v", "x1", "y1", "x2", "y2")
    rows = chords(edges, at).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    rows = rows.select(*KEY, "c", F.posexplode("c").alias("i", "a")).select(*KEY, "a", F.slice("c", F.col("i") + 2, F.size("c")).alias("rest"))

    def turn(p: tuple, q: tuple, r: tuple) -> Column:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def cross(b: Column) -> Column:
        a = F.col("a")
        apart = (a["u"] != b["u"]) & (a["u"] != b["v"]) & (a["v"] != b["u"]) & (a["v"] != b["v"])
        near = (F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"])) & (F.least(b["x1"], b["x2"]) <= F.greatest(a["x1"], a["x2"]))
        a1, a2, b1, b2 = (a["x1"], a["y1"]), (a["x2"], a["y2"]), (b["x1"], b["y1"]), (b["x2"], b["y2"])
        return apart & near & (turn(a1, a2, b1) * turn(a1, a2, b2) < 0) & (turn(b1, b2, a1) * turn(b1, b2, a2) < 0)

    met = rows.select(*KEY, "a", F.explode("rest").alias("b")).filter(cross(F.col("b")))
    dx, dy, ex, ey = (F.col(p) - F.col(q) for p, q in (("a.x2", "a.x1"), ("a.y2", "a.y1"), ("b.x2", "b.x1"), ("b.y2", "b.y1")))
    angle = F.degrees(F.atan2(F.abs(dx * ey - dy * ex), F.abs(dx * ex + dy * ey)))
    return met.select(*KEY, F.col("a.u").alias("u1"), F.col("a.v").alias("v1"), F.col("b.u").alias("u2"), F.col("b.v").alias("v2"), angle.alias("angle"))


def crossing_scores(edges: DataFrame, at: DataFrame) -> DataFrame:
    """edge_crossings: 1 - crossings by how many pairs of edges could cross (1 if none could). crossing_angle: 1 - mean
    deviation of crossing angles from 90 degrees, by 90 (1 without a crossing)."""
    from .corpus import degrees

    d = F.col("deg")
    most = degrees(edges).groupBy("graph_id").agg((F.sum("deg") / 2).alias("m"), F.sum(d * (d - 1)).alias("s")).select("graph_id", (F.col("m") * (F.col("m") - 1) / 2 - F.col("s") / 2).alias("most"))
    found = crossings(edges, at).groupBy(*KEY).agg(F.count("*").alias("c"), F.avg(F.abs(90 - F.col("angle")) / 90).alias("off"))
    df = at.select(*KEY).distinct().join(most, "graph_id").join(found, KEY, "left")
    return df.select(*KEY, F.coalesce("c", F.lit(0)).alias("n_crossings"), F.when(F.col("most") > 0, 1 - F.coalesce("c", F.lit(0)) / F.col("most")).otherwise(F.lit(1.0)).alias("edge_crossings"), (1 - F.coalesce("off", F.lit(0.0))).alias("crossing_angle"))


def places(at: DataFrame) -> DataFrame:
    """(graph_id, layout, p): the nodes of a drawing and their places, in order, as one array."""
    return at.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("node", "x", "y"))).alias("p"))


def _far(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def node_resolution(at: DataFrame) -> DataFrame:
    """The least distance of two nodes by the box's diagonal; null for a point. Pairs of nodes stay within the row."""
    nearest = F.array_min(F.transform("p", lambda a, i: F.array_min(F.transform(F.slice("p", i + 2, F.size("p")), lambda b: _far(a, b)))))
    of = lambda c: F.col(f"p.{c}")
    diag = F.hypot(F.array_max(of("x")) - F.array_min(of("x")), F.array_max(of("y")) - F.array_min(of("y")))
    return places(at).filter(F.size("p") > 1).select(*KEY, diag.alias("diag"), nearest.alias("d")).select(*KEY, F.when(F.col("diag") > 0, F.col("d") / F.col("diag")).alias("node_resolution"))


def node_uniformity(at: DataFrame) -> DataFrame:
    """Evenness over a grid of k x k cells on the box, k = ceil(sqrt(n)): 1 - sum of |in cell - n / k^2| by what all nodes
    in one cell would give; 1 for a single node."""
    side = F.ceil(F.sqrt("n"))

    def cell(c: str, low: str, size: str) -> Column:
        return F.when(F.col(size) > 0, F.least(side - 1, F.floor((F.col(c) - F.col(low)) / F.col(size) * side))).otherwise(F.lit(0))

    cells = at.join(boxes(at), KEY).groupBy(*KEY, "n", cell("x", "x0", "w").alias("i"), cell("y", "y0", "h").alias("j")).agg(F.count("*").alias("k"))
    c = side * side
    off = F.sum(F.abs(F.col("k") - F.col("n") / c)) + (c - F.count("*")) * F.col("n") / c
    worst = 2 * F.col("n") * (1 - 1 / c)
    return cells.groupBy(*KEY, "n").agg(F.when(c > 1, 1 - off / worst).otherwise(F.lit(1.0)).alias("node_uniformity")).drop("n")


def _edge_and_node(edges: DataFrame, at: DataFrame) -> DataFrame:
    """Chords with every node that isn't an end of theirs (px, py)."""
    places = at.groupBy(*KEY).agg(F.collect_list(F.struct("node", "x", "y")).alias("p"), F.count("*").alias("n"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diag"))
    return chords(edges, at).join(places, KEY)


def gabriel_ratio(edges: DataFrame, at: DataFrame) -> DataFrame:
    """1 - how many nodes lie inside the disc over an edge, by edges times other nodes; straight chords only."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    df = _edge_and_node(edges, at).withColumns({"mx": mx, "my": my, "r": _length() / 2})
    inside = F.size(F.filter("p", lambda p: (p["node"] != F.col("u")) & (p["node"] != F.col("v")) & (F.hypot(p["x"] - F.col("mx"), p["y"] - F.col("my")) < F.col("r") - 1e-9)))
    most = F.count("*") * (F.max("n") - 2)
    return df.groupBy(*KEY).agg(F.when(most > 0, 1 - F.sum(inside) / most).otherwise(F.lit(1.0)).alias("gabriel_ratio_nodes"))


def node_edge_occlusion(edges: DataFrame, at: DataFrame) -> DataFrame:
    """1 - the share of edges that another node, as wide as drawn (0.75% of the diagonal), touches."""
    df = _edge_and_node(edges, at).withColumns({"dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1")}).withColumn("l2", F.col("dx") ** 2 + F.col("dy") ** 2)

    def touches(p: Column) -> Column:
        t = F.when(F.col("l2") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - F.col("x1")) * F.col("dx") + (p["y"] - F.col("y1")) * F.col("dy")) / F.col("l2")))).otherwise(F.lit(0.0))
        far = F.hypot(p["x"] - F.col("x1") - t * F.col("dx"), p["y"] - F.col("y1") - t * F.col("dy"))
        return (p["node"] != F.col("u")) & (p["node"] != F.col("v")) & (far < F.col("diag") * RADIUS / DIAGONAL)

    return df.groupBy(*KEY).agg((1 - F.avg(F.exists("p", touches).cast("double"))).alias("node_edge_occlusion"))


def neighbourhood_preservation(edges: DataFrame, at: DataFrame) -> DataFrame:
    """Neighbours in the graph among the degree-many nearest nodes in the drawing (ties: smaller node), as the share of
    common ones in all of both, summed over nodes."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    near = edges.select("graph_id", ends.alias("s")).groupBy("graph_id", "s.a").agg(F.collect_list("s.b").alias("near"))
    maps = near.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "near"))).alias("near"))

    def shared(a: Column) -> Column:
        own = F.element_at("near", a["node"])
        by = F.array_sort(F.transform(F.filter("p", lambda b: b["node"] != a["node"]), lambda b: F.struct(F.round(_far(a, b), 9).alias("d"), b["node"].alias("b"))))
        nearest = F.transform(F.slice(by, 1, F.size(own)), lambda x: x["b"])
        return F.struct(F.size(F.array_intersect(own, nearest)).alias("common"), F.size(F.array_union(own, nearest)).alias("all"))

    counts = places(at).join(maps, "graph_id").select(*KEY, F.transform(F.filter("p", lambda a: F.map_contains_key("near", a["node"])), shared).alias("s"))
    total = lambda c: F.aggregate(F.col(f"s.{c}"), F.lit(0), lambda x, y: x + y)
    return counts.filter(F.size("s") > 0).select(*KEY, (total("common") / total("all")).alias("neighbourhood_preservation"))


def path_flags(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """contains_bends: some path has two line commands or more; contains_curves: some has a curve or arc command. The e of
    an exponent is neither; null paths are straight."""
    p = F.col(path)
    return paths.groupBy(*by).agg(F.coalesce(F.bool_or(F.regexp_count(p, F.lit("[LHVlhv]")) >= 2), F.lit(False)).alias("contains_bends"), F.coalesce(F.bool_or(p.rlike("[CQSTAcqsta]")), F.lit(False)).alias("contains_curves"))


def bends_path(start: Column, bends: Column, end: Column) -> Column:
    """The path of an edge through its bends (an array of x, y): M x,y L x,y ...; null without bends, which is a straight edge."""
    text = lambda p: F.concat(F.format_string("%.6g", p["x"]), F.lit(","), F.format_string("%.6g", p["y"]))
    way = F.concat(F.transform(bends, text), F.array(text(end)))
    return F.when(F.size(bends) > 0, F.concat(F.lit("M "), text(start), F.lit(" L "), F.concat_ws(" L ", way)))


def oriented_bends(start: Column, bends: Column) -> Column:
    """bends, turned round if there are two or more and the last is nearer to start than the first."""
    far = lambda p: F.hypot(p["x"] - start["x"], p["y"] - start["y"])
    return F.when((F.size(bends) > 1) & (far(F.element_at(bends, -1)) < far(F.element_at(bends, 1))), F.reverse(bends)).otherwise(bends)


#: Scores by name, each a function of edges and places that gives (graph_id, layout, score).
METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_metric(name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    if name in METRICS:
        raise ValueError(f"metric {name} exists")
    METRICS[name] = f


register_metric("aspect_ratio", lambda edges, at: aspect_ratio(at))
register_metric("node_resolution", lambda edges, at: node_resolution(at))
register_metric("node_uniformity", lambda edges, at: node_uniformity(at))
register_metric("edge_crossings", lambda edges, at: crossing_scores(edges, at).select(*KEY, "edge_crossings"))
register_metric("crossing_angle", lambda edges, at: crossing_scores(edges, at).select(*KEY, "crossing_angle"))
for _f in (edge_length_deviation, edge_orthogonality, angular_resolution, gabriel_ratio, node_edge_occlusion, neighbourhood_preservation):
    register_metric("gabriel_ratio_nodes" if _f is gabriel_ratio else _f.__name__, _f)


def measured(edges: DataFrame, at: DataFrame, names: list[str]) -> DataFrame:
    """(graph_id, layout, names): the registered scores of every drawing, null where one has none."""
    out = at.select(*KEY).distinct()
    for name in names:
        out = out.join(METRICS[name](edges, at).select(*KEY, name), KEY, "left")
    return out
