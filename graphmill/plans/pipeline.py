"""The stages of a corpus and the plan that runs them: generate, stage, sample, dedup, layout, metrics.

Every stage reads and writes versioned tables below one folder, so it can be run again alone: what is done is left
out by anti-joins, and audits keep what was dropped from coming back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import layouts
from ..operators import corpus, generate, isomorphism, properties, scoring, tables
from ..session import materialize
from ..sources import readers, registry, sinks
from ..sources.sinks import Versioned

ORDER = ("generate", "stage", "sample", "dedup", "layout", "metrics")
DEDUP = ("properties", "wl_vf2")
STAGES: dict[str, Callable[[Context], None]] = {}
# Sources of which a sample is kept, and its size.
CAPS = {
    "TUDataset/QM9": 2500, "TUDataset/ZINC_full": 2500, "TUDataset/Yeast": 2500, "TUDataset/NCI-H23": 2500, "TUDataset/TRIANGLES": 2500,
    "TUDataset/GITHUB_STARGAZERS": 2500, "TUDataset/deezer_ego_nets": 2500,
}
# Seconds after which a layout of one graph is given up.
LIMITS = {"HOLA": 10.0, "planarization-ortho": 10.0, "drgraph": 10.0}


@dataclass(frozen=True)
class Config:
    """What a run is told; unknown or missing names are errors.

    sample_caps has the size of the sample by source, sample_cap that of all others (0: kept whole), sample_offset gives
    another sample without another seed elsewhere. limit_s is a time limit for every layout of a graph (0: none), limits has
    others by layout. verify: so many graphs of every source are laid out first. files: graphs and drawings are written as
    files below out too, which all executors must see.
    """

    out: str
    seed: int = 1
    count: int = 200
    n_min: int = corpus.FLOOR
    n_max: int = corpus.N_MAX
    generators: tuple[str, ...] = ()
    catalogues: bool = True
    landing: str = ""
    sources: tuple[str, ...] = ()
    max_graphs: int = 0
    sample_cap: int = 0
    sample_caps: dict[str, int] = field(default_factory=lambda: dict(CAPS))
    sample_offset: int = 0
    dedup: str = "properties"
    layouts: tuple[str, ...] = ("circular", "random", "spectral", "stress-majorization")
    exclude_layouts: tuple[str, ...] = ()
    limit_s: float = 0
    limits: dict[str, float] = field(default_factory=lambda: dict(LIMITS))
    verify: int = 0
    files: bool = False

    @staticmethod
    def of(values: dict[str, object]) -> Config:
        """From names and values; ${VAR} and ${VAR:-default} in texts are replaced."""
        names = {f.name for f in fields(Config)}
        if unknown := set(values) - names:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if "out" not in values:
            raise ValueError("missing setting: out")
        if values.get("dedup", "properties") not in DEDUP:
            raise ValueError(f"dedup is one of {DEDUP}")
        return Config(**{k: tuple(expand(x) for x in v) if isinstance(v, (list, tuple)) else expand(v) for k, v in values.items()})  # type: ignore[arg-type]


def expand(value: object) -> object:
    """value with environment variables replaced, if it is a text."""
    if not isinstance(value, str):
        return value

    def of(m: re.Match) -> str:
        found = os.environ.get(m[1], m[3])
        if found is None:
            raise ValueError(f"environment variable {m[1]} is not set")
        return found

    return re.sub(r"\$\{(\w+)(:-([^}]*))?\}", of, value)


@dataclass
class Context:
    spark: SparkSession
    config: Config
    tables: dict[str, Versioned] = field(default_factory=dict)

    def table(self, name: str) -> Versioned:
        return self.tables.setdefault(name, Versioned(self.spark, f"{self.config.out}/{name}"))

    def rows(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one."""
        t = self.table(name)
        return t.read() if t.exists() else self.spark.createDataFrame([], schema)


def register(name: str) -> Callable[[Callable[[Context], None]], Callable[[Context], None]]:
    def add(f: Callable[[Context], None]) -> Callable[[Context], None]:
        if name in STAGES:
            raise ValueError(f"stage {name} exists")
        STAGES[name] = f
        return f

    return add


def plan(what: str = "all", only: list[str] | None = None) -> list[str]:
    """Names of the stages to run: all, from:<stage>, or one; extra registered stages come last and are not part of from:."""
    known = [*(n for n in ORDER if n in STAGES), *sorted(set(STAGES) - set(ORDER))]
    if what == "all":
        out = known
    elif what.startswith("from:"):
        if what[5:] not in ORDER:
            raise ValueError(f"no stage {what[5:]}")
        out = [n for n in known if n in ORDER and ORDER.index(n) >= ORDER.index(what[5:])]
    elif what in STAGES:
        out = [what]
    else:
        raise ValueError(f"no stage {what}")
    return [n for n in out if not only or n in only]


def run(context: Context, what: str = "all", only: list[str] | None = None) -> list[str]:
    done = plan(what, only)
    for name in done:
        STAGES[name](context)
    return done


GRAPHS = "graph_id string, generator string, category string, source string, seed long, n int, us array<int>, vs array<int>, xs array<double>, ys array<double>, paths array<string>, bends array<array<struct<x:double,y:double>>>"
AUDIT = "dropped_graph_id string"
MARKS = "source string, key string, kept long, cap_reached boolean, completed_at_utc timestamp"


def _with_properties(graphs: DataFrame) -> DataFrame:
    """Manifest rows of new graphs, with their packed form beside."""
    return graphs.join(properties.manifest24(graphs.select("graph_id", "n", "us", "vs")), "graph_id").withColumn("generated_at_utc", F.current_timestamp())


def _known(c: Context) -> DataFrame:
    """Ids that the manifest has or an audit dropped."""
    return tables.known_ids((c.rows("manifest", GRAPHS), "graph_id"), (c.rows("sampling_audit", AUDIT), "dropped_graph_id"), (c.rows("dedup_audit", AUDIT), "dropped_graph_id"))


def _add(c: Context, graphs: DataFrame) -> DataFrame:
    """Append graphs that neither the manifest nor an audit knows; returns those that couldn't be written as files."""
    schema = T._parse_datatype_string(GRAPHS)
    graphs = graphs.select(*(F.col(f.name) if f.name in graphs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    fresh = materialize(sinks.checked(tables.not_done(graphs, _known(c), ["graph_id"])))
    lost = fresh.select("graph_id", F.lit("").alias("problem")).limit(0)
    if c.config.files:
        named = fresh.withColumn("path", sinks.graph_path(F.col("category"), F.col("source"), F.col("graph_id")))
        texts = sinks.graph_texts(named, ("graph_id", "path"))
        written = materialize(sinks.write_files(texts, c.config.out).filter("problem IS NOT NULL"))
        lost = named.select("graph_id", "path").join(written, "path").select("graph_id", "problem")
        fresh = fresh.join(lost, "graph_id", "left_anti")
    c.table("manifest").append(_with_properties(fresh))
    return lost


@register("generate")
def run_generate(c: Context) -> None:
    k = c.config
    made = [(generate.generated(c.spark, k.count, k.seed, k.n_min, k.n_max, list(k.generators) or None), "generated")]
    if k.catalogues:
        made += [(generate.calibration(c.spark), "calibration"), (generate.exhaustive_small(c.spark), "generated")]
    for graphs, category in made:
        _add(c, graphs.withColumns({"category": F.lit(category), "source": F.lit("")}))


@register("stage")
def run_stage(c: Context) -> None:
    """Stage the folders landing/<source> of the sources that were asked for and have no completion mark under the same bounds.
    A source's mark is written after its graphs and reasons, so a broken run stages it again."""
    for name in c.config.sources:
        source = registry.SOURCES[name]
        drawn = source.category == "graphs_with_drawings"
        low = corpus.FLOOR if source.category in ("real_world", "benchmark") else corpus.N_MIN
        key = sinks.completion_key(low, c.config.n_max, c.config.max_graphs)
        if not sinks.incomplete(c.spark.createDataFrame([(name,)], "source string"), c.rows("completed", MARKS), key).count():
            continue
        parsed = readers.read_graphs(c.spark, f"{c.config.landing}/{name}", source.format, drawn)
        kept, reasons = readers.stage(parsed, name, source.category, _known(c), c.config.max_graphs, low, c.config.n_max)
        kept = materialize(kept)
        lost = _add(c, kept.withColumns({"generator": F.lit(name), "seed": F.lit(0).cast("long")}))
        failed = lost.groupBy(F.lit(name).alias("source"), F.substring_index("problem", "(", 1).alias("reason")).agg(F.count("*").alias("n"))
        c.table("reasons").append(reasons.unionByName(failed))
        c.table("completed").append(sinks.completion(name, key, kept, c.config.max_graphs))


@register("sample")
def run_sample(c: Context) -> None:
    """Sources of real_world graphs keep their caps, spread over strata; all other rows stay, those of no category too."""
    whole = c.table("manifest").read()
    pooled = F.coalesce(F.col("category") == "real_world", F.lit(False))
    pool, k = whole.filter(pooled), c.config
    caps = k.sample_caps if not k.sample_cap else {r[0]: k.sample_cap for r in pool.select(F.coalesce("source", F.lit(""))).distinct().collect()} | k.sample_caps  # sources are registered ones
    seed = f"sample|{k.seed}" + (f"|{k.sample_offset}" if k.sample_offset else "")
    kept = materialize(tables.stratified_sample(pool, caps, seed))
    lost = tables.not_done(pool, kept, ["graph_id"])
    c.table("sampling_audit").append(lost.select(F.col("graph_id").alias("dropped_graph_id"), "source", "n_nodes", "density"))
    c.table("manifest").write(whole.filter(~pooled).unionByName(kept.select(*whole.columns)))


@register("dedup")
def run_dedup(c: Context) -> None:
    """Graphs of equal invariants (floats to six places) are one, in mode wl_vf2 only isomorphic ones; the audit is appended
    before the manifest is replaced."""
    whole = c.table("manifest").read()
    kinds = dict(whole.dtypes)
    if c.config.dedup not in DEDUP:
        raise ValueError(f"dedup is one of {DEDUP}")
    keys = {f"k_{n}": F.bround(n, 6) if kinds[n] == "double" else F.col(n) for n in properties.NAMES} if c.config.dedup == "properties" else {"k_class": F.coalesce("class_id", "graph_id")}
    source = whole if c.config.dedup == "properties" else whole.join(isomorphism.isomorphism_classes(whole.select("graph_id", "n", "us", "vs")), "graph_id", "left")
    df = source.select("graph_id", "source", "category", "generator", *(e.alias(k) for k, e in keys.items()))
    df = df.withColumn("tier", tables.tier(F.col("category"), F.col("generator"), F.col("source")))
    df = tables.with_source_size(df)
    audit = tables.dedup_audit(tables.duplicates(df, list(keys), [F.col("tier"), F.col("source_size"), F.col("graph_id")]))
    audit = c.table("dedup_audit").append(audit)
    c.table("manifest").write(whole.join(audit.select(F.col("dropped_graph_id").alias("graph_id")).distinct(), "graph_id", "left_anti"))


def chosen_layouts(k: Config) -> list[str]:
    """Known layouts of the configuration that aren't excluded; unknown names are left out."""
    return [x for x in k.layouts if (x in layouts.LAYOUTS or x in layouts.ELSEWHERE) and x not in k.exclude_layouts]


@register("layout")
def run_layout(c: Context) -> None:
    """Layout and scores in one pass for the pairs that have no row yet, after rows of lost graphs are removed."""
    k, manifest = c.config, c.table("manifest").read()
    scores = c.table("scores")
    if scores.exists():
        scores.write(tables.without_orphans(scores.read(), manifest))
    packed = manifest.select("graph_id", "n", "us", "vs", "is_planar", "is_tree", "category", *(x for x in scoring.GIVEN if x in manifest.columns))
    done = scores.read() if scores.exists() else None
    names = chosen_layouts(k)
    limits = {x: s for x in names if (s := k.limits.get(x, k.limit_s))}
    first = tables.top_ids(manifest, k.verify) if k.verify else None
    drawn = scoring.laid_out_and_scored(packed, names, k.seed, done, flags=True, limit_s=limits, geometry=k.files, first=first)
    if k.files:
        drawn = materialize(drawn)
        at = drawn.filter("outcome = 'ok'").join(manifest.select("graph_id", "n", "us", "vs", "category", "source"), "graph_id")
        at = at.withColumn("path", sinks.drawing_path(F.col("layout"), F.col("category"), F.col("source"), F.regexp_replace("graph_id", r"\.\w+$", "")))
        points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y")))
        pictures = at.select(F.concat("path", F.lit(".svg")).alias("path"), sinks.svg(points, F.col("paths")).alias("text"))
        texts = sinks.graph_texts(at.withColumns({"graph_id": F.concat("graph_id", F.lit(".geg")), "path": F.concat("path", F.lit(".geg"))}), ("path",)).select("path", "text")
        lost = sinks.write_files(pictures.unionByName(texts), k.out).filter("problem IS NOT NULL")
        c.table("unwritten").append(lost)
        drawn = drawn.drop("xs", "ys", "paths")
    scores.append(drawn)


@register("metrics")
def run_metrics(c: Context) -> None:
    """Envelope of the scores by graph."""
    from ..operators.analysis import QUALITY, envelope, mean_of

    ok = c.table("scores").read().filter("outcome = 'ok'").withColumn("quality", mean_of(QUALITY))
    c.table("envelope").write(envelope(ok, "graph_id", [*QUALITY, "quality"]))
