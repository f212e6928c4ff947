"""The flow chart of the corpus: bands of links at each side of a node, columns without overlap, and its summary."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_bands(links: DataFrame, height: Column) -> DataFrame:
    """links(source, target, value) with the band that each takes of its source's and its target's side: value's share of
    the side's sum times height, one below the other in the order of the other end."""

    def band(side: str, other: str) -> tuple[Column, Column]:
        whole = Window.partitionBy(side)
        upto = whole.orderBy(other).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("value").over(whole)
        end = F.when(total > 0, F.sum("value").over(upto) / total * height).otherwise(F.lit(0.0))
        return F.when(total > 0, end - F.col("value") / total * height).otherwise(F.lit(0.0)), end

    (s0, s1), (t0, t1) = band("source", "target"), band("target", "source")
    return links.withColumns({"source_from": s0, "source_to": s1, "target_from": t0, "target_to": t1})


def stacked(nodes: DataFrame, pad: float, bottom: float | None = None) -> DataFrame:
    """nodes(column, name, y, height) moved down, column by column, until each top is pad below the bottom before it; then
    up, if bottom is given, where the last ones pass it. A column is a few boxes of a chart and is swept in one piece."""
    import pandas as pd

    def sweep(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["y", "name"], ignore_index=True)
        low = -float("inf")
        for i in range(len(b)):
            b.loc[i, "y"] = max(b.loc[i, "y"], low)
            low = b.loc[i, "y"] + b.loc[i, "height"] + pad
        high = float("inf") if bottom is None else bottom + pad
        for i in range(len(b) - 1, -1, -1):
            b.loc[i, "y"] = min(b.loc[i, "y"], high - pad - b.loc[i, "height"])
            high = b.loc[i, "y"]
        return b

    cols = nodes.select("column", "name", F.col("y").cast("double").alias("y"), F.col("height").cast("double").alias("height"))
    return cols.groupBy("column").applyInPandas(sweep, cols.schema)


def boundaries(ordered: DataFrame, order: str, cluster: str) -> DataFrame:
    """ordered with new: whether the row before, in order, is of another cluster."""
    w = Window.orderBy(order)  # a few columns of a table
    return ordered.withColumn("new", F.coalesce(F.lag(cluster).over(w) != F.col(cluster), F.lit(False)))


def cluster_share(shares: DataFrame) -> DataFrame:
    """shares(metric, kind, share) summed by metric: of clusters, of the layout, and the residual."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("share")))
    return shares.groupBy("metric").agg(of("cluster").alias("clusters"), of("layout").alias("layout"), of("residual").alias("residual"))


def summary(cohorts: DataFrame, layouts: DataFrame, reasons: DataFrame) -> str:
    """The chart's numbers as JSON: graphs by cohort and source, drawings by layout, graphs lost by reason. Each input has
    a row for each of its few names."""
    out: dict[str, object] = {"cohorts": {}, "drawings": {}, "rejected": {}}
    for r in cohorts.orderBy("category", "source").collect():
        out["cohorts"].setdefault(r.category, {})[r.source] = r.n  # type: ignore[attr-defined]
    out["drawings"] = {r.layout: r.n for r in layouts.orderBy(F.desc("n"), "layout").collect()}
    out["rejected"] = {r.reason: r.n for r in reasons.orderBy(F.desc("n"), "reason").collect()}
    out["total_drawings"] = sum(out["drawings"].values())  # type: ignore[attr-defined]
    return json.dumps(out, indent=1)


def chart_svg(nodes: DataFrame, links: DataFrame, width: float = 900.0, box: float = 12.0) -> str:
    """An SVG of nodes(column, name, y, height) and links(source, target, and their bands)."""
    import html

    rows = nodes.orderBy("column", "y").collect()
    columns = sorted({r["column"] for r in rows})
    x = {c: i * (width - box) / max(1, len(columns) - 1) for i, c in enumerate(columns)}
    at = {r.name: (x[r["column"]], r.y) for r in rows}
    out = [f'<rect x="{x[r["column"]]:.6g}" y="{r.y:.6g}" width="{box:g}" height="{r.height:.6g}"/><text x="{x[r["column"]] + box + 2:.6g}" y="{r.y + r.height / 2:.6g}">{html.escape(r.name)}</text>' for r in rows]
    for r in links.orderBy("source", "target").collect():
        (x0, y0), (x1, y1) = at[r.source], at[r.target]
        x0, mid = x0 + box, (x0 + box + x1) / 2
        a, b, c, d = y0 + r.source_from, y0 + r.source_to, y1 + r.target_from, y1 + r.target_to
        out.append(f'<path fill="#888" fill-opacity="0.4" d="M {x0:.6g},{a:.6g} C {mid:.6g},{a:.6g} {mid:.6g},{c:.6g} {x1:.6g},{c:.6g} L {x1:.6g},{d:.6g} C {mid:.6g},{d:.6g} {mid:.6g},{b:.6g} {x0:.6g},{b:.6g} Z"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} 600" font-size="9">' + "".join(out) + "</svg>"
