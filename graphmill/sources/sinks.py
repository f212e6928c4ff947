"""Sinks: checked manifests, long timings, versioned tables, CSV and SVG export, completion marks, the HTML index."""

from __future__ import annotations

import hashlib
import html
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from .readers import CATEGORIES, NESTED

#: Columns by which the HTML index filters drawings.
FILTERS = ("layout", "category", "source")


def checked(manifest: DataFrame) -> DataFrame:
    """manifest; a row of unknown category, or without a source where its category needs one, fails the job when it is read."""
    ok = F.col("category").isin(*CATEGORIES) & (~F.col("category").isin(*NESTED) | (F.coalesce(F.col("source"), F.lit("")) != ""))
    return manifest.withColumn("category", F.when(F.coalesce(ok, F.lit(False)), F.col("category")).otherwise(F.raise_error(F.concat(F.lit("bad category or source of "), F.coalesce("graph_id", F.lit("a row"))))))


def long_timings(df: DataFrame, ids: list[str], seconds: str, name: str) -> DataFrame:
    """One row for each entry of the map column seconds: ids, name, seconds."""
    return df.select(*ids, F.explode(seconds).alias(name, "seconds"))


def csv_text(df: DataFrame) -> DataFrame:
    """df with doubles as %.9g and missing ones as nan, for export to CSV."""
    kinds = dict(df.dtypes)
    return df.select(*(F.when(F.col(c).isNull() | F.isnan(c), F.lit("nan")).otherwise(F.format_string("%.9g", F.col(c))).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


class Versioned:
    """A table kept as versions below one folder: a new one is written beside the last and then named current, so a job
    may replace the table that it reads; a failed job leaves the old version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("x").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1] if version is None else version}")

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """df as the next version."""
        n = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/v{n}")
        return self.read(n)

    def append(self, df: DataFrame) -> DataFrame:
        """df added to the current version's files."""
        n = (self.versions() or [1])[-1]
        df.write.mode("append").parquet(f"{self.path}/v{n}")
        return self.read(n)

    def backup(self, to: str) -> str:
        """A copy of the current version, named by the time."""
        at = f"{to.rstrip('/')}/{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
        self.read().write.parquet(at)
        return at

    def prune(self, keep: int = 2) -> None:
        for n in self.versions()[:-keep]:
            self._fs.delete(self._at(f"v{n}"), True)


def read_through(spark: SparkSession, path: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows from the table at path if that was made from the same inputs (paths, sizes and times of their files),
    else they are built and kept there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for p in sorted(inputs):
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        for s in [fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else fs.listStatus(at):
            seen.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
    name = hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build().write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def completion_key(n_min: int, n_max: int, max_graphs: int) -> str:
    return f"n_min={n_min};n_max={n_max};max_graphs={max_graphs}"


def incomplete(sources: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Sources without a completion mark under this key."""
    return sources.join(marks.filter(F.col("key") == key).select("source").distinct(), "source", "left_anti")


def completion(source: str, key: str, kept: DataFrame, cap: int) -> DataFrame:
    """The completion mark of a staged source."""
    return kept.agg(F.lit(source).alias("source"), F.lit(key).alias("key"), F.count("*").alias("kept"), ((F.count("*") >= cap) & F.lit(cap > 0)).alias("cap_reached"), F.current_timestamp().alias("completed_at_utc"))


def _folder(category: Column, source: Column, kind: Column) -> Column:
    """category[/source]; a bad category, or a source where none belongs or none where one does, fails the job."""
    nested = category.isin(*NESTED)
    has = F.coalesce(source, F.lit("")) != ""
    bad = F.raise_error(F.concat(F.lit("no path for category "), F.coalesce(category, F.lit("(none)")), F.lit(", source "), F.coalesce(source, F.lit("(none)"))))
    return F.when(F.coalesce(category.isin(*CATEGORIES), F.lit(False)) & (nested == has), F.concat_ws("/", kind, F.when(nested, source))).otherwise(bad.cast("string"))


def graph_path(category: Column, source: Column, graph_id: Column) -> Column:
    """Where a graph's file is, below the corpus' folder."""
    top = F.when(category == "graphs_with_drawings", F.lit("graphs-with-drawings")).otherwise(F.concat(F.lit("graphs/"), category))
    return F.concat_ws("/", _folder(category, source, top), graph_id)


def drawing_path(layout: Column, category: Column, source: Column, graph_id: Column) -> Column:
    """Where a drawing's file is, below the corpus' folder. A cohort without sources has none in the path."""
    source = F.when(category.isin(*NESTED), source)
    return F.concat_ws("/", _folder(category, source, F.concat(F.lit("drawings/"), layout, F.lit("/"), category)), graph_id)


def graph_texts(graphs: DataFrame, keep: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keep, text and problem of graphs(graph_id, n, us, vs and maybe xs, ys, paths): GraphML, or drawn JSON where the id ends
    in .geg; a row that can't be written has a null text and the error's name."""
    given = [c for c in ("xs", "ys", "paths") if c in graphs.columns]
    sent = graphs.select(*dict.fromkeys([*keep, "graph_id", "n", "us", "vs", *given]))
    schema = T.StructType([*(sent.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("problem", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                xs, ys, ways = (getattr(r, c, None) for c in ("xs", "ys", "paths"))
                try:
                    xy = None if xs is None or ys is None else [(float(x), float(y)) for x, y in zip(xs, ys, strict=True)]
                    write = paths.to_geg if str(r.graph_id).endswith(".geg") else paths.to_graphml
                    rows.append((*(getattr(r, c) for c in keep), write(int(r.n), [int(u) for u in r.us], [int(v) for v in r.vs], xy, None if ways is None else list(ways)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((*(getattr(r, c) for c in keep), None, f"write_failed({type(e).__name__})"))
            yield pd.DataFrame(rows, columns=schema.names).astype({c: b[c].dtype for c in keep})

    return sent.mapInPandas(run, schema)


def write_files(texts: DataFrame, root: str) -> DataFrame:
    """Write texts(path, text) to files below root, a folder that all executors see, and return (path, problem). A file is
    written beside its name and then renamed, so no reader meets half of one and a repeated task does no harm. Rows without
    a text have their problem told."""
    schema = "path string, problem string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                why = None if isinstance(text, str) else "write_failed(no text)"
                if why is None:
                    at = Path(root) / path
                    part = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
                    try:
                        if not at.resolve().is_relative_to(Path(root).resolve()):
                            raise ValueError(path)
                        at.parent.mkdir(parents=True, exist_ok=True)
                        part.write_text(text, encoding="utf-8")
                        os.replace(part, at)
                    except (OSError, ValueError) as e:
                        part.unlink(missing_ok=True)
                        why = f"write_failed({type(e).__name__})"
                rows.append((path, why))
            yield pd.DataFrame(rows, columns=["path", "problem"])

    return texts.select("path", "text").mapInPandas(run, schema)


def svg(nodes: Column, edges: Column, radius: float = 7.5) -> Column:
    """The SVG text of a drawing: nodes an array of (x, y), edges an array of path texts."""
    lines = F.array_join(F.transform(edges, lambda p: F.concat(F.lit('<path fill="none" stroke="#777" d="'), p, F.lit('"/>'))), "")
    dots = F.array_join(F.transform(nodes, lambda n: F.format_string(f'<circle r="{radius}" cx="%.6g" cy="%.6g"/>', n["x"], n["y"])), "")
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="-520 -520 1040 1040">'), lines, dots, F.lit("</svg>"))


def _listed(drawings: DataFrame) -> DataFrame:
    """The columns of the index, in its order."""
    filters = (F.coalesce(c, F.lit("(none)")).alias(c) for c in FILTERS)
    return drawings.select(*filters, "name", "path").orderBy(*FILTERS, "name", "path")


def _page(choices: dict[str, list[str]], rows: list[dict], files: list[str]) -> str:
    data = json.dumps(rows).replace("</", "<\\/")
    pick = "".join(f'<select id="{c}"><option value="">{c}</option>' + "".join(f"<option>{html.escape(v)}</option>" for v in choices[c]) + "</select>" for c in FILTERS)
    rest = "".join(f'\n<script src="{html.escape(quote(f))}"></script>' for f in files)
    return f"""<!doctype html><meta charset="utf-8"><title>drawings</title>{pick}<input id="text" placeholder="id"><ul id="list"></ul><script>
const all = {data}, on = id => document.getElementById(id);
function show() {{ on("list").replaceChildren(...all.filter(d => ["layout", "category", "source"].every(c => !on(c).value || String(d[c]) === on(c).value) && d.name.includes(on("text").value)).map(d => {{ const li = document.createElement("li"), a = document.createElement("a"); a.href = d.path; a.textContent = d.layout + " / " + d.name; li.append(a); return li; }})); }}
for (const id of ["layout", "category", "source", "text"]) on(id).addEventListener("input", show);
</script>{rest}<script>show();</script>"""


def index_page(drawings: DataFrame) -> str:
    """An HTML page that lists all drawings (layout, category, source, name, path) and filters them by these."""
    rows = [r.asDict() for r in _listed(drawings).collect()]
    return _page({c: sorted({r[c] for r in rows}) for c in FILTERS}, rows, [])


def write_index(drawings: DataFrame, page: str, most: int = 10_000) -> int:
    """Write the index of all drawings to the file page, and return their number. Rows beyond the first most go to files of
    most rows each in a folder beside the page, which loads them; the driver never holds more than one partition of them."""
    at = Path(page)
    folder = at.with_name(f"{at.stem}_data")
    seen: dict[str, set[str]] = {c: set() for c in FILTERS}
    first: list[dict] = []
    files: list[str] = []
    part: list[dict] = []
    n = 0

    def put() -> None:
        folder.mkdir(exist_ok=True)
        name = f"{len(files) + 1:05d}.js"
        (folder / name).write_text(f"all.push(...{json.dumps(part)});\n", encoding="utf-8")
        files.append(f"{folder.name}/{name}")
        part.clear()

    for r in _listed(drawings).toLocalIterator():
        n += 1
        for c in FILTERS:
            seen[c].add(r[c])
        (first if n <= most else part).append(r.asDict())
        if len(part) == most:
            put()
    if part:
        put()
    at.write_text(_page({c: sorted(seen[c]) for c in FILTERS}, first, files), encoding="utf-8")
    return n
