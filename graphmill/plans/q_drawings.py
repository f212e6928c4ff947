"""Queries on drawings of the corpus: layouts, standard form, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, drawings
from ..operators import scoring
from .q_corpus import WITH, edges
from .registry import query, table

EMB = "emb AS (SELECT graph_id, 'emb_0' AS layout, node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM deg JOIN embeddings ON vec_id = node)"
CIRCLE = """circ AS (SELECT graph_id, 'circular' AS layout, node, cos(a) AS x, sin(a) AS y FROM
  (SELECT graph_id, node, 2 * pi() * (row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1) / count(*) OVER (PARTITION BY graph_id) AS a FROM deg))"""
POS = f"{WITH}, {EMB}, {CIRCLE}, pos AS (SELECT * FROM emb UNION ALL SELECT * FROM circ)"
BOX = "box AS (SELECT graph_id, layout, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS diag, count(*) AS n FROM pos GROUP BY 1, 2)"
CHORD = "chord AS (SELECT p.graph_id, p.layout, u, v, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS len FROM edges e JOIN pos p ON e.graph_id = p.graph_id AND u = p.node JOIN pos q ON e.graph_id = q.graph_id AND v = q.node AND p.layout = q.layout)"
ONE = f"{WITH}, {EMB}, pos AS (SELECT * FROM emb), {BOX}, {CHORD}"
BOTH = f"{POS}, {BOX}, {CHORD}"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.degrees(edges(spark, sf)).select("graph_id", "node")


def one(spark: SparkSession, sf: str) -> DataFrame:
    return drawings.from_vectors(nodes(spark, sf), table(spark, sf, "embeddings"), 0)


def both(spark: SparkSession, sf: str) -> DataFrame:
    return one(spark, sf).unionByName(drawings.circular(nodes(spark, sf)))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """df with cols to six places; a rounded zero has no sign."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


@query(f"{WITH}, {CIRCLE} SELECT graph_id, layout, node, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM circ")
def layout_circular(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.circular(nodes(spark, sf)), "x", "y")


def _unit(at: int) -> str:
    digits = " + ".join(f"instr('123456789abcdef', substr(d, {at + i}, 1)) * {16 ** (5 - i)}" for i in range(6))
    return f"({digits})::DOUBLE / {16 ** 6}"


@query(f"{WITH}, h AS (SELECT graph_id, node, md5(('0x' || substr(md5('1|random|' || graph_id), 1, 15))::BIGINT || '|' || node) AS d FROM deg) SELECT graph_id, 'random' AS layout, node, {_unit(1)} AS x, {_unit(7)} AS y FROM h")
def layout_random(spark, sf):  # noqa: ANN001, ANN201
    return drawings.random(nodes(spark, sf))


@query(f"{WITH}, {EMB} SELECT * FROM emb")
def layout_embedding(spark, sf):  # noqa: ANN001, ANN201
    return one(spark, sf)


@query(f"{POS}, {BOX} SELECT pos.graph_id, pos.layout, node, round((x - (x0 + x0 + w) / 2) * CASE WHEN diag > 0 THEN 1000 / diag ELSE 1 END, 6) + 0.0 AS x, round((y - (y0 + y0 + h) / 2) * CASE WHEN diag > 0 THEN 1000 / diag ELSE 1 END, 6) + 0.0 AS y FROM pos JOIN box ON pos.graph_id = box.graph_id AND pos.layout = box.layout")
def standardise(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.standardise(both(spark, sf)), "x", "y")


PATHS = "CASE (u + v) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'M 0,0 L 1e-3,1' WHEN 2 THEN 'M 0 0 L 1 1 L 2 0' WHEN 3 THEN 'M 0,0 C 1e-5,2 3,4 4,4' WHEN 4 THEN 'm 0 0 h 3 v 2' WHEN 5 THEN 'M 0 0 H 2e4' ELSE 'M 1 1 a 2 2 0 0 1 3 3' END"


@query(f"{WITH}, p AS (SELECT graph_id, v, {PATHS} AS path FROM edges) SELECT graph_id, v, coalesce(bool_or(length(regexp_replace(path, '[^LHVlhv]', '', 'g')) >= 2), false) AS contains_bends, coalesce(bool_or(regexp_matches(path, '[CQSTAcqsta]')), false) AS contains_curves FROM p GROUP BY 1, 2")
def geometry_flags(spark, sf):  # noqa: ANN001, ANN201
    return drawings.path_flags(edges(spark, sf).withColumn("path", F.expr(PATHS)), ["graph_id", "v"])


@query(f"{POS}, {BOX} SELECT graph_id, layout, round(CASE WHEN greatest(w, h) > 0 THEN least(w, h) / greatest(w, h) ELSE 1.0 END, 6) AS aspect_ratio FROM box")
def aspect_ratio(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.aspect_ratio(both(spark, sf)), "aspect_ratio")


@query(f"{BOTH}, m AS (SELECT graph_id, layout, avg(len) AS m FROM chord GROUP BY 1, 2) SELECT graph_id, layout, round(CASE WHEN max(m) > 0 THEN 1 / (1 + avg(abs(len - m)) / max(m)) ELSE 1.0 END, 6) AS edge_length_deviation FROM chord JOIN m USING (graph_id, layout) GROUP BY 1, 2")
def edge_length_deviation(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.edge_length_deviation(edges(spark, sf), both(spark, sf)), "edge_length_deviation")


@query(f"{BOTH}, a AS (SELECT graph_id, layout, degrees(atan2(abs(y2 - y1), abs(x2 - x1))) AS a FROM chord) SELECT graph_id, layout, round(1 - avg(least(a, 90 - a) / 45), 9) AS edge_orthogonality FROM a GROUP BY 1, 2")
def edge_orthogonality(spark, sf):  # noqa: ANN001, ANN201
    return drawings.edge_orthogonality(edges(spark, sf), both(spark, sf)).withColumn("edge_orthogonality", F.round("edge_orthogonality", 9))


@query(f"""{ONE}, s AS (SELECT graph_id, layout, u AS node, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM chord UNION ALL SELECT graph_id, layout, v, degrees(atan2(y1 - y2, x1 - x2)) FROM chord),
  g AS (SELECT graph_id, layout, node, a, lead(a) OVER (PARTITION BY graph_id, layout, node ORDER BY a) - a AS gap FROM s),
  f AS (SELECT graph_id, layout, 360.0::DOUBLE / count(*) AS ideal, least(min(gap), min(a) + 360 - max(a)) AS low FROM g GROUP BY graph_id, layout, node HAVING count(*) > 1)
  SELECT graph_id, layout, round(1 - avg(abs(ideal - low) / ideal), 6) AS angular_resolution FROM f GROUP BY 1, 2""")
def angular_resolution(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.angular_resolution(edges(spark, sf), one(spark, sf)), "angular_resolution")


def _turn(p: str, q: str, r: str) -> str:
    def at(k: str) -> tuple[str, str]:
        return f"{k[1]}.x{k[0]}", f"{k[1]}.y{k[0]}"

    (px, py), (qx, qy), (rx, ry) = at(p), at(q), at(r)
    return f"(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


CROSS = f"""cr AS (SELECT a.graph_id, a.layout, degrees(atan2(abs((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)), abs((a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1)))) AS angle
  FROM chord a JOIN chord b ON a.graph_id = b.graph_id AND a.layout = b.layout AND (a.u < b.u OR a.u = b.u AND a.v < b.v) AND a.u <> b.u AND a.u <> b.v AND a.v <> b.u AND a.v <> b.v
  AND {_turn('1a', '2a', '1b')} * {_turn('1a', '2a', '2b')} < 0 AND {_turn('1b', '2b', '1a')} * {_turn('1b', '2b', '2a')} < 0)"""


@query(f"""{ONE}, {CROSS}, c AS (SELECT graph_id, layout, count(*) AS c FROM cr GROUP BY 1, 2),
  most AS (SELECT graph_id, (sum(deg) / 2) * (sum(deg) / 2 - 1) / 2 - sum(deg * (deg - 1)) / 2 AS most FROM deg GROUP BY 1)
  SELECT box.graph_id, box.layout, coalesce(c, 0) AS n_crossings, round(CASE WHEN most > 0 THEN 1 - coalesce(c, 0) / most ELSE 1.0 END, 6) AS edge_crossings FROM box JOIN most ON box.graph_id = most.graph_id LEFT JOIN c ON box.graph_id = c.graph_id AND box.layout = c.layout""")
def edge_crossings(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.crossing_scores(edges(spark, sf), one(spark, sf)).drop("crossing_angle"), "edge_crossings")


@query(f"{ONE}, {CROSS}, c AS (SELECT graph_id, layout, avg(abs(90 - angle) / 90) AS off FROM cr GROUP BY 1, 2) SELECT box.graph_id, box.layout, round(1 - coalesce(off, 0), 6) AS crossing_angle FROM box LEFT JOIN c ON box.graph_id = c.graph_id AND box.layout = c.layout")
def crossing_angle(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.crossing_scores(edges(spark, sf), one(spark, sf)).select("graph_id", "layout", "crossing_angle"), "crossing_angle")


PAIR = "pair AS (SELECT p.graph_id, p.layout, p.node AS a, q.node AS b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM pos p JOIN pos q ON p.graph_id = q.graph_id AND p.layout = q.layout AND p.node <> q.node)"


@query(f"{ONE}, {PAIR} SELECT graph_id, layout, round(CASE WHEN max(diag) > 0 THEN min(d) / max(diag) END, 6) AS node_resolution FROM pair JOIN box USING (graph_id, layout) GROUP BY 1, 2")
def node_resolution(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.node_resolution(one(spark, sf)), "node_resolution")


@query(f"""{ONE}, c AS (SELECT pos.graph_id, pos.layout, n, ceil(sqrt(n)) AS k, CASE WHEN w > 0 THEN least(ceil(sqrt(n)) - 1, floor((x - x0) / w * ceil(sqrt(n)))) ELSE 0 END AS i, CASE WHEN h > 0 THEN least(ceil(sqrt(n)) - 1, floor((y - y0) / h * ceil(sqrt(n)))) ELSE 0 END AS j FROM pos JOIN box ON pos.graph_id = box.graph_id AND pos.layout = box.layout),
  g AS (SELECT graph_id, layout, n, k * k AS c, count(*) AS m FROM c GROUP BY graph_id, layout, n, k, i, j)
  SELECT graph_id, layout, round(CASE WHEN c > 1 THEN 1 - (sum(abs(m - n / c)) + (c - count(*)) * n / c) / (2 * n * (1 - 1 / c)) ELSE 1.0 END, 6) AS node_uniformity FROM g GROUP BY graph_id, layout, n, c""")
def node_uniformity(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.node_uniformity(one(spark, sf)), "node_uniformity")


EN = "en AS (SELECT c.*, p.node, p.x AS px, p.y AS py FROM chord c JOIN pos p ON c.graph_id = p.graph_id AND c.layout = p.layout AND p.node <> u AND p.node <> v)"


@query(f"""{ONE}, {EN}, i AS (SELECT graph_id, layout, count(*) AS c FROM en WHERE sqrt((px - (x1 + x2) / 2) ** 2 + (py - (y1 + y2) / 2) ** 2) < len / 2 - 1e-9 GROUP BY 1, 2), m AS (SELECT graph_id, layout, count(*) AS m FROM chord GROUP BY 1, 2)
  SELECT m.graph_id, m.layout, round(CASE WHEN m * (n - 2) > 0 THEN 1 - coalesce(c, 0) / (m * (n - 2)) ELSE 1.0 END, 6) AS gabriel_ratio_nodes FROM m JOIN box ON m.graph_id = box.graph_id AND m.layout = box.layout LEFT JOIN i ON m.graph_id = i.graph_id AND m.layout = i.layout""")
def gabriel_ratio(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.gabriel_ratio(edges(spark, sf), one(spark, sf)), "gabriel_ratio_nodes")


@query(f"""{ONE}, {EN}, t AS (SELECT *, CASE WHEN len > 0 THEN greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len))) ELSE 0.0 END AS t FROM en),
  o AS (SELECT DISTINCT t.graph_id, t.layout, u, v FROM t JOIN box ON t.graph_id = box.graph_id AND t.layout = box.layout WHERE sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) < diag * 7.5 / 1000)
  SELECT chord.graph_id, chord.layout, round(1 - avg(CASE WHEN o.u IS NULL THEN 0.0 ELSE 1.0 END), 6) AS node_edge_occlusion FROM chord LEFT JOIN o ON chord.graph_id = o.graph_id AND chord.layout = o.layout AND chord.u = o.u AND chord.v = o.v GROUP BY 1, 2""")
def node_edge_occlusion(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.node_edge_occlusion(edges(spark, sf), one(spark, sf)), "node_edge_occlusion")


@query(f"""{ONE}, {PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, layout, a ORDER BY round(d, 9), b) AS r FROM pair),
  k AS (SELECT r.graph_id, layout, a, b, deg, r <= deg AS near FROM r JOIN deg ON r.graph_id = deg.graph_id AND a = node), j AS (SELECT k.graph_id, k.layout, near, s.u IS NOT NULL AS adj FROM k LEFT JOIN sym s ON k.graph_id = s.graph_id AND a = s.u AND b = s.v)
  SELECT graph_id, layout, round(count(*) FILTER (WHERE near AND adj) / count(*) FILTER (WHERE near OR adj), 6) AS neighbourhood_preservation FROM j GROUP BY 1, 2""")
def neighbourhood_preservation(spark, sf):  # noqa: ANN001, ANN201
    return rounded(drawings.neighbourhood_preservation(edges(spark, sf), one(spark, sf)), "neighbourhood_preservation")


@query()
def kruskal_stress(spark, sf):  # noqa: ANN001, ANN201
    return scoring.scored(edges(spark, sf), one(spark, sf), ["kruskal_stress"])


#: The layouts that take little time; the others are in layout_baur_brandes.
FUSED = ["circular", "random", "spectral", "arc-bfs", "stress-majorization", "pivot-mds", "radial-tree"]


@query()
def fused_layout_metrics(spark, sf):  # noqa: ANN001, ANN201
    return scoring.laid_out_and_scored(corpus.pack(edges(spark, sf)), FUSED)
