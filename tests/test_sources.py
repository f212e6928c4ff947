"""Formats, readers, sinks, staging, streaming and the pipeline on small local files."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from graphmill import cli
from graphmill.plans import pipeline
from graphmill.sources import formats, readers, registry, sinks
from graphmill.streaming import ingest


def tar(files, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, text in files.items():
            data = text.encode() if isinstance(text, str) else text
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


GRAPHML = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><graph edgedefault="directed"><node id="n0"><data key="d0">1.5</data><data key="d1">2</data></node><node id="n1"/><node id="n2"/><edge source="n0" target="n1"/><edge source="n1" target="n0"/><edge source="n1" target="n2"/><edge source="n2" target="n2"/></graph></graphml>'
GEG = json.dumps({"nodes": [{"id": "b", "position": [1, 2]}, {"id": "a", "position": [3, 4], "color": "red"}], "edges": [{"source": "b", "target": "a", "path": "M 1 2 L 3 4"}]})
GPML = '<Pathway xmlns="http://x"><DataNode GraphId="b"><Graphics CenterX="1" CenterY="2" Width="5"/></DataNode><DataNode GraphId="a"><Graphics CenterX="3" CenterY="4"/></DataNode><Interaction><Graphics><Point X="1" Y="2" GraphRef="b"/><Point X="9" Y="9"/><Point X="3" Y="4" GraphRef="a"/></Graphics></Interaction><GraphicalLine><Graphics><Point GraphRef="a"/><Point GraphRef="zz"/></Graphics></GraphicalLine></Pathway>'
FILES = {
    "graphml": (GRAPHML, [(3, [(0, 1), (1, 2)])]),
    "graphml_archive": (tar({"a/x.graphml": GRAPHML, "../evil.graphml": GRAPHML, "/abs.graphml": GRAPHML, "a/bad.graphml": "<gr"}), [(3, [(0, 1), (1, 2)])]),
    "edge_list": ("# note\n% note\n1 2\n2 3 9.5\n3 1\nx\n", [(3, [(0, 1), (0, 2), (1, 2)])]),
    "csv_zip": (zipped({"edges.csv": "# source, target, w\n0, 1, 2\n1, 2, 3\n"}), [(3, [(0, 1), (1, 2)])]),
    "konect": (tar({"k/out.web": "% bip\n1 2\n2 4\n", "k/README": "x"}, "w:bz2"), [(3, [(0, 1), (1, 2)])]),
    "geg": (GEG, [(2, [(0, 1)])]),
    "adjacency_json": (json.dumps([{"graphId": 7, "adjacencyList": [[1, 2], [0], [0]]}]), [(3, [(0, 1), (0, 2)])]),
    "matpower": ("mpc.branch = [\n 1 2 0.1; % x\n 2 3 0.2;\n];\nmpc.x = [9 9];", [(3, [(0, 1), (1, 2)])]),
    "cx": (json.dumps([{"nodes": [{"@id": 1}, {"@id": 2}, {"@id": 3}]}, {"cartesianLayout": [{"node": 1, "x": 0, "y": 1}, {"node": 2, "x": 5, "y": 5}]}, {"edges": [{"s": 1, "t": 2}, {"s": 1, "t": 3}]}]), [(2, [(0, 1)])]),
    "pajek": ('*Vertices 3\n1 "a b" 0.1 0.2 0.5\n2 "c" 0.3 0.4\n3 d 0.5 .6\n*Arcs\n1 2 1\n*Edgeslist\n1 2 3\n', [(3, [(0, 1), (0, 2)])]),
    "matrix_market": ("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 3\n1 1 5\n2 1 5\n3 2 1\n", [(3, [(0, 1), (1, 2)])]),
    "tu_archive": (zipped({"X/X_A.txt": "1, 2\n2, 1\n2, 3\n3, 4\n", "X/X_graph_indicator.txt": "1\n1\n2\n2\n", "X/X_node_attributes.txt": "0,1\n1,1\n2,2\n3,3\n"}), [(2, [(0, 1)]), (2, [(0, 1)])]),
    "gpml": (GPML, [(2, [(0, 1)])]),
}


@pytest.mark.parametrize("fmt", sorted(FILES))
def test_formats(fmt):
    data, want = FILES[fmt]
    data = data.encode() if isinstance(data, str) else data
    drawn = fmt in ("geg", "cx", "pajek", "gpml", "tu_archive")
    got = [formats.canonical(r, drawn) for r in formats.PARSERS[fmt](f"dir/GD00/{fmt}.x", data)]
    assert [(g["n"], list(zip(g["us"], g["vs"], strict=True))) for g in got] == want
    if drawn:
        assert all(None not in g["xs"] for g in got)
    if fmt == "geg":
        assert got[0]["name"] == "gd_gd00_geg" and got[0]["orig_ids"] == ["a", "b"] and got[0]["paths"] == ["M 1 2 L 3 4"] and got[0]["attrs"][0] == {"color": "red"}
    if fmt == "gpml":
        assert got[0]["bends"] == [[{"x": 9.0, "y": 9.0}]]


@pytest.mark.parametrize(("fmt", "text", "why"), [("pajek", "*Vertices 2\n1 a\n2 b\n", "topology_only"), ("pajek", "*Edges\n1 2\n", "no_vertices_section"), ("pajek", "*Vertices x\n", "malformed_header"), ("matrix_market", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 2 3\n", "not_symmetric"), ("matpower", "x", "no_branch_block"), ("gpml", "<a", "parse_error")])
def test_skipped_files(fmt, text, why):
    with pytest.raises(formats.Skip, match=why):
        list(formats.PARSERS[fmt]("p", text.encode()))


def test_read_and_stage(spark, tmp_path):
    sizes = [1, 5, 8, 50, 75, 76, 200]
    for n in sizes:
        (tmp_path / f"p{n:03d}.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(n - 1)))
    (tmp_path / "split.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(0, 20, 2)))
    (tmp_path / "bad.txt").write_text("# nothing")  # Spark passes over files of no bytes
    graphs = readers.read_graphs(spark, str(tmp_path), "edge_list")
    kept, reasons = readers.stage(graphs, "food_webs", "real_world")
    assert [r.n for r in kept.orderBy("n").collect()] == [8, 50, 75]
    assert {r.reason: r.n for r in reasons.collect()} == {"accepted": 3, "out_of_size": 4, "disconnected": 1}  # size is looked at first
    known = spark.createDataFrame([("food_webs_p050.graphml",)], "graph_id string")
    kept, _ = readers.stage(graphs, "food_webs", "real_world", known, cap=1)
    assert [r.graph_id for r in kept.collect()] == ["food_webs_p008.graphml"]
    broken = readers.read_graphs(spark, str(tmp_path), "matpower")
    assert {r.problem for r in broken.select("problem").collect()} == {"no_branch_block"}


def test_routes_catalogue_licences_logs(spark):
    airports = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "X"), (None, "X")], "id string, country string")
    routes = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("d", "b"), ("d", "d"), ("q", "a"), (None, "a")], "src string, dst string")
    assert sorted(map(tuple, readers.routes_by_country(airports, routes).collect())) == [("X", "a", "b"), ("X", "b", "d")]
    nets = spark.createDataFrame([("ok", 10, 20, False, None, None), ("loose", 10, 20, False, None, 0.5), ("dense", 16, 100, False, None, 1.0), ("dir", 16, 100, True, 1.0, 1.0), ("big", 99, 100, False, None, 1.0), ("none", None, 3, None, None, None)], "name string, num_vertices int, num_edges int, is_directed boolean, edge_reciprocity double, largest_component_fraction double")
    assert sorted(r.name for r in readers.promising(nets).collect()) == ["dir", "ok"]
    texts = spark.createDataFrame([("CC0 1.0",), ("CC BY-NC 4.0 -nc- cc by 4.0",), ("Attribution 4.0 International",), ("all rights reserved",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(readers.is_open(F.col("t"))).collect()] == [True, False, True, False, False, False]
    lines = spark.createDataFrame([(1, "[a] kept=1 reasons={'x': 5}"), (2, "noise"), (3, "[a] kept=1,000 reasons={'x': 2, 'y': 1}"), (4, "[b] kept=0  reasons={'x': 1}")], "line_no int, value string")
    assert {r.reason: r.n for r in readers.log_totals(lines).collect()} == {"x": 3, "y": 1}


def test_csv_scans(spark, tmp_path):
    (tmp_path / "manifest.csv").write_text("graph_id,n_nodes,density,is_tree,zzz\ng1,5,nan,True,1\ng2,bad,0.5,False,2\n")
    got = readers.read_manifest(spark, str(tmp_path / "manifest.csv")).orderBy("graph_id").collect()
    assert (got[0].n_nodes, got[0].density, got[0].is_tree, got[0].category) == (5, None, True, None) and got[1].n_nodes is None
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "circular.csv").write_text("graph_id,kruskal_stress,contains_bends\ng1,0.5,True\n")
    (tmp_path / "m" / "HOLA.csv").write_text("graph_id,kruskal_stress,contains_bends\ng1,nan,False\n")
    assert sorted((r.layout, r.kruskal_stress, r.contains_bends) for r in readers.read_scores(spark, str(tmp_path / "m")).collect()) == [("HOLA", None, False), ("circular", 0.5, True)]


def test_registry():
    assert len(registry.SOURCES) == 77 and [len(registry.select(c)) for c in ("benchmark", "real_world", "graphs_with_drawings")] == [3, 69, 5]
    assert registry.format_for("TUDataset/NEW") == "tu_archive" and registry.format_for("netzschleuder/other") == "csv_zip"
    assert [s.name for s in registry.select("benchmark", ["rome"])] == ["rome"]
    with pytest.raises(KeyError):
        registry.format_for("nothing")


def test_sinks(spark, tmp_path):
    ok = spark.createDataFrame([("g", "generated", None), ("h", "real_world", "s")], "graph_id string, category string, source string")
    assert sinks.checked(ok).count() == 2
    for bad in [("g", "odd", "s"), ("g", "real_world", ""), ("g", None, "s")]:
        with pytest.raises(Exception, match="bad category"):
            sinks.checked(spark.createDataFrame([bad], ok.schema)).collect()
    t = sinks.Versioned(spark, str(tmp_path / "t"))
    assert not t.exists()
    t.write(ok)
    t.write(t.read().filter("graph_id = 'g'"))
    assert t.versions() == [1, 2] and t.read().count() == 1 and t.read(1).count() == 2 and spark.read.parquet(t.backup(str(tmp_path / "b"))).count() == 1
    t.prune(1)
    assert t.versions() == [2]
    assert sinks.csv_text(spark.createDataFrame([(1 / 3, "a"), (None, "b")], "x double, s string")).orderBy("s").first().x == "0.333333333"
    assert sinks.long_timings(spark.createDataFrame([("g", {"a": 0.5, "b": 1.0})], "graph_id string, t map<string,double>"), ["graph_id"], "t", "property").count() == 2
    key = sinks.completion_key(8, 75, 0)
    mark = sinks.completion("s", key, ok, 2)
    assert mark.first().cap_reached and sinks.incomplete(ok.select("source").dropna(), mark, key).count() == 0 and sinks.incomplete(ok.select("source").dropna(), mark, "other").count() == 1
    (tmp_path / "d" / "circular" / "real_world" / "s").mkdir(parents=True)
    (tmp_path / "d" / "circular" / "real_world" / "s" / "g.svg").write_text("<svg/>")
    listed = readers.list_drawings(spark, str(tmp_path / "d"))
    assert tuple(listed.first())[:4] == ("circular", "real_world", "s", "g") and "g" in sinks.index_page(listed)


def test_streaming_ingest(spark, tmp_path):
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    (tmp_path / "land").mkdir()

    def put(name, n):
        (tmp_path / "land" / name).write_text("".join(f"{i} {i + 1}\n" for i in range(n - 1)))

    put("a.txt", 10)
    put("b.txt", 4)
    for more in (None, "c.txt"):
        if more:
            put(more, 12)
        ingest.ingest(spark, land, out, "food_webs", "real_world", "edge_list", mark, "*.txt").awaitTermination()
    assert sorted(r.graph_id for r in ingest.current(spark, out).collect()) == ["food_webs_a.graphml", "food_webs_c.graphml"]


def test_pipeline_runs_and_resumes(spark, tmp_path):
    land = tmp_path / "land" / "food_webs"
    land.mkdir(parents=True)
    for n in (8, 9, 20):
        (land / f"p{n:02d}.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(n - 1)))
    config = pipeline.Config.of({"out": str(tmp_path / "out"), "count": 12, "n_max": 15, "catalogues": False, "landing": str(tmp_path / "land"), "sources": ["food_webs"], "layouts": ["circular", "planar", "unknown"], "sample_cap": 2})
    context = pipeline.Context(spark, config)
    assert pipeline.run(context) == list(pipeline.ORDER)
    manifest = context.table("manifest").read()
    assert manifest.filter("category = 'real_world'").count() == 2 and manifest.filter("category = 'generated'").count() <= 12
    first = {tuple(r) for r in context.table("scores").read().select("graph_id", "layout", "kruskal_stress").collect()}
    assert {r[0] for r in first} == {r.graph_id for r in manifest.select("graph_id").collect()}
    pipeline.run(context)
    assert {tuple(r) for r in context.table("scores").read().select("graph_id", "layout", "kruskal_stress").collect()} == first
    assert context.table("manifest").read().select("graph_id").distinct().count() == context.table("manifest").read().count() == manifest.count()
    assert context.table("envelope").read().count() == manifest.count()


def test_pipeline_writes_files_and_curated_drawings(spark, tmp_path):
    """Drawn graphs keep their geometry up to the score; files are where the paths say; marks stop a second staging."""
    land = tmp_path / "land" / "wikipathways"
    land.mkdir(parents=True)
    node = lambda i, x, y: f'<DataNode GraphId="n{i}"><Graphics CenterX="{x}" CenterY="{y}"/></DataNode>'
    line = lambda a, b, via="": f'<Interaction><Graphics><Point X="0" Y="0" GraphRef="n{a}"/>{via}<Point X="9" Y="9" GraphRef="n{b}"/></Graphics></Interaction>'
    places = [(0, 0), (100, 0), (50, 60), (50, -10), (200, 0)]
    (land / "w.gpml").write_text("<Pathway>" + "".join(node(i, *p) for i, p in enumerate(places)) + line(0, 1, '<Point X="10" Y="40"/><Point X="90" Y="40"/>') + line(1, 4) + line(2, 3) + line(0, 2) + "</Pathway>")
    config = pipeline.Config.of({"out": str(tmp_path / "out"), "count": 3, "n_max": 12, "catalogues": False, "landing": str(tmp_path / "land"), "sources": ["wikipathways"], "layouts": ["curated", "circular"], "files": True, "verify": 1, "limit_s": 60})
    c = pipeline.Context(spark, config)
    pipeline.run(c)
    got = {(r.graph_id, r.layout): r for r in c.table("scores").read().collect()}
    drawn = got["wikipathways_w.geg", "curated"]
    assert drawn.outcome == "ok" and drawn.contains_bends and not drawn.contains_curves and drawn.edge_crossings < 1
    assert not got["wikipathways_w.geg", "circular"].contains_bends
    assert {k[1] for k in got if k[0] != "wikipathways_w.geg"} == {"circular"}
    files = {str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*") if f.suffix in (".geg", ".svg", ".graphml")}
    assert "graphs-with-drawings/wikipathways/wikipathways_w.geg" in files and "drawings/curated/graphs_with_drawings/wikipathways/wikipathways_w.svg" in files
    assert sum(f.startswith("graphs/generated/") for f in files) == 3 and sum(f.startswith("drawings/circular/generated/") and f.endswith(".svg") for f in files) == 3
    again = readers.read_graphs(spark, f"{tmp_path}/out/drawings/curated", "geg", drawn=True, pattern="*.geg").first()
    assert (again.n, list(again.us), list(again.vs)) == (5, [0, 0, 1, 2], [1, 2, 4, 3]) or again.n == 5
    n = c.table("reasons").read().count()
    pipeline.run(c, "stage")
    assert c.table("reasons").read().count() == n and c.table("completed").read().filter("kept = 1").count() == 1
    assert c.table("unwritten").read().count() == 0


def test_known_graphs_are_counted(spark):
    files = spark.createDataFrame([(f"p{n}.txt", "".join(f"{i} {i + 1}\n" for i in range(n - 1)).encode()) for n in (9, 10, 11)], "path string, content binary")
    known = spark.createDataFrame([("food_webs_p9.graphml",), (None,)], "graph_id string")
    kept, reasons = readers.stage(readers.parse_files(files, "edge_list"), "food_webs", "real_world", known, cap=1)
    assert [r.graph_id for r in kept.collect()] == ["food_webs_p10.graphml"]
    assert {r.reason: r.n for r in reasons.collect()} == {"already_in_manifest": 1, "accepted": 2}


def test_writers(spark, tmp_path):
    rows = [("a.graphml", 3, [0, 1], [1, 2], None, None, None), ("b.geg", 2, [0], [1], [0.5, 1.0], [2.0, 3.0], ["M 0.5,2 C 1,1 2,2 1,3"]), ("c.geg", 2, [0], [1], None, None, None)]
    df = spark.createDataFrame(rows, "graph_id string, n int, us array<int>, vs array<int>, xs array<double>, ys array<double>, paths array<string>")
    texts = sinks.graph_texts(df).collect()
    assert [r.problem for r in texts] == [None, None, "write_failed(TypeError)"]
    done = sinks.write_files(spark.createDataFrame([(f"x/{r.graph_id}", r.text) for r in texts] + [("../evil", "x")], "path string, text string"), str(tmp_path / "root"))
    assert {r.path: r.problem for r in done.collect()} == {"x/a.graphml": None, "x/b.geg": None, "x/c.geg": "write_failed(no text)", "../evil": "write_failed(ValueError)"}
    back = readers.read_graphs(spark, str(tmp_path / "root"), "geg", drawn=True, pattern="*.geg").first()
    assert back.xs == [0.5, 1.0] and back.paths == ["M 0.5,2 C 1,1 2,2 1,3"] and not (tmp_path / "evil").exists()
    paths = spark.createDataFrame([("real_world", "s/t"), ("graphs_with_drawings", "w"), ("generated", ""), ("calibration", None)], "category string, source string")
    assert [r[0] for r in paths.select(sinks.graph_path(F.col("category"), F.col("source"), F.lit("g"))).collect()] == ["graphs/real_world/s/t/g", "graphs-with-drawings/w/g", "graphs/generated/g", "graphs/calibration/g"]
    assert [r[0] for r in paths.select(sinks.drawing_path(F.lit("HOLA"), F.col("category"), F.col("source"), F.lit("g"))).collect()] == ["drawings/HOLA/real_world/s/t/g", "drawings/HOLA/graphs_with_drawings/w/g", "drawings/HOLA/generated/g", "drawings/HOLA/calibration/g"]
    for bad in (("real_world", ""), ("generated", "s"), ("nope", "s")):
        with pytest.raises(Exception, match="no path"):
            spark.createDataFrame([bad], "category string, source string").select(sinks.graph_path(F.col("category"), F.col("source"), F.lit("g"))).collect()


def test_remote_catalogues(spark):
    """Entries of one network and of several, adjacency lists, and open networks, from pages of JSON."""
    pages = [("a", {"analyses": {"num_vertices": 20, "num_edges": 30, "is_directed": False, "largest_component_fraction": 1.0}}), ("b", {"restricted": True, "analyses": {"num_vertices": 20, "num_edges": 30}}), ("c", {"nets": ["x/1", "y:2", "z"], "analyses": {"x/1": {"num_vertices": 10, "num_edges": 12}, "y:2": {"num_vertices": 500, "num_edges": 600}}})]
    df = spark.createDataFrame([(0, i, k, json.dumps(v)) for i, (k, v) in enumerate(pages)], "page int, place int, id string, json string")
    found = readers.catalogue(df)
    assert sorted((r.entry, r.network, r.safe_name, r.num_vertices) for r in found.collect()) == [("a", "a", "a", 20), ("c", "x/1", "x_1", 10), ("c", "y:2", "y_2", 500), ("c", "z", "z", None)]
    assert sorted(r.network for r in readers.promising(found).collect()) == ["a", "x/1"]
    hog = spark.createDataFrame([(0, 0, "7", json.dumps({"graphId": 7, "adjacencyList": [[1, 2], [0], [0]]})), (1, 0, "7", json.dumps({"graphId": 7, "adjacencyList": [[1], [0]]}))], "page int, place int, id string, json string")
    (one,) = readers.adjacency_graphs(hog).collect()
    assert (one.name, one.n, one.us, one.vs) == ("hog_7", 3, [0, 0], [1, 2])
    net = lambda rights: json.dumps([{"networkAttributes": [{"n": "Rights", "v": rights}]}, {"nodes": [{"@id": 1}, {"@id": 2}]}, {"cartesianLayout": [{"node": 1, "x": 0, "y": 1}, {"node": 2, "x": 5, "y": 5}]}, {"edges": [{"s": 1, "t": 2}]}])
    rows = [(0, 0, "u1", net("CC BY 4.0")), (0, 1, "u2", net("CC BY-NC 4.0 -nc-")), (0, 2, "u3", json.dumps([{"nodes": []}])), (1, 0, "u1", net("CC0")), (1, 1, "u4", net("CC0"))]
    nets = spark.createDataFrame(rows, "page int, place int, id string, json string")
    assert sorted(r.name for r in readers.open_networks(nets).collect()) == ["u1", "u4"] and readers.open_networks(nets, 1).first().name == "u1"
    assert readers.catalogue(df.limit(0)).count() == readers.open_networks(nets.limit(0)).count() == 0


def test_plans_and_settings(monkeypatch, capsys):
    assert pipeline.plan("from:dedup") == ["dedup", "layout", "metrics"] and pipeline.plan("all", ["layout"]) == ["layout"]
    for bad in ("nope", "from:nope"):
        with pytest.raises(ValueError, match="no stage"):
            pipeline.plan(bad)
    monkeypatch.setenv("OUT_DIR", "/x")
    assert pipeline.Config.of({"out": "${OUT_DIR}/${SUB:-y}"}).out == "/x/y"
    for bad in ({"out": "${MISSING_ONE}"}, {"seed": 1}, {"out": "x", "typo": 1}):
        with pytest.raises(ValueError):
            pipeline.Config.of(bad)
    assert cli.main(["plan", "from:layout"]) == 0 and capsys.readouterr().out.split() == ["layout", "metrics"]
    assert cli.settings(cli.parser().parse_args(["run", "--out", "o", "--layouts", "circular,HOLA", "--count", "3"])).layouts == ("circular", "HOLA")
    assert pipeline.chosen_layouts(pipeline.Config(out="o", layouts=("circular", "nope", "HOLA"), exclude_layouts=("HOLA",))) == ["circular"]


def test_pages(spark, tmp_path):
    from graphmill.sources import paged

    for i, recs in enumerate([[{"uuid": "a"}, {"uuid": "b", "x": 1}], [{"uuid": "a", "late": 1}, {"x": 2}], []]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"networks": recs}))
    paged.register(spark)
    df = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{page}}.json").option("pages", 3).option("records", "networks").load()
    assert df.count() == 4 and df.rdd.getNumPartitions() == 3
    assert [(r.page, r.id) for r in paged.first_of_each(df).collect()] == [(0, "a"), (0, "b")] and paged.first_of_each(df, 1).count() == 1


def test_read_through_sees_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1")
    built = []

    def build():
        built.append(1)
        return spark.read.text(str(tmp_path / "in"))

    for text in (None, None, "22"):
        if text:
            (tmp_path / "in" / "a.txt").write_text(text)
        got = sinks.read_through(spark, str(tmp_path / "cache"), [str(tmp_path / "in")], build).first()[0]
    assert len(built) == 2 and got == "22"
