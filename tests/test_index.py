"""The HTML index has every drawing."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from graphmill.sources import sinks


def drawings(spark, n):
    layout = F.when(F.col("id") < n - 3, "circular").otherwise("zigzag")
    return spark.range(n).select(layout.alias("layout"), F.lit("generated").alias("category"), F.when(F.col("id") % 2 == 0, "s").alias("source"), F.format_string("g%05d", "id").alias("name"), F.format_string("/d/%05d.svg", "id").alias("path"))


def test_no_drawing_is_left_out(spark, tmp_path):
    page = sinks.index_page(drawings(spark, 10_003))
    assert "g10002" in page and "<option>zigzag</option>" in page
    assert sinks.write_index(drawings(spark, 25), str(tmp_path / "my index.html"), 10) == 25
    page = (tmp_path / "my index.html").read_text()
    rows = json.loads(re.search(r"const all = (\[.*?\]), on", page)[1])
    files = re.findall(r'<script src="([^"]+)">', page)
    for f in files:
        rows += json.loads(re.fullmatch(r"all\.push\(\.\.\.(.*)\);\n", (tmp_path / f.replace("%20", " ")).read_text())[1])
    assert len(files) == 2 and sorted(r["name"] for r in rows) == [f"g{i:05d}" for i in range(25)]
    assert rows == sorted(rows, key=lambda r: [r[c] for c in ("layout", "category", "source", "name")])
    assert "<option>zigzag</option>" in page and "<option>(none)</option>" in page and {r["source"] for r in rows} == {"s", "(none)"}
    assert sinks.write_index(drawings(spark, 0), str(tmp_path / "none.html")) == 0
