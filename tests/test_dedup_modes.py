"""Both modes of the stage dedup, on graphs that the invariants can't tell apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphmill.plans import pipeline


def torus(steps):
    """The graph on the 4 x 4 torus whose nodes are joined by the given steps."""
    return sorted({tuple(sorted((4 * a + b, 4 * ((a + x) % 4) + (b + y) % 4))) for a in range(4) for b in range(4) for x, y in steps})


@pytest.mark.parametrize(("mode", "kept"), [("properties", {"rook"}), ("wl_vf2", {"rook", "shrikhande"})])
def test_modes(spark, tmp_path, mode, kept):
    rook, shrikhande = torus([(0, 1), (0, 2), (1, 0), (2, 0)]), torus([(0, 1), (1, 0), (1, 1)])
    turned = sorted(tuple(sorted(((5 * u + 3) % 16, (5 * v + 3) % 16))) for u, v in rook)
    graphs = [(k, "x", "generated", "", 0, 16, [u for u, _ in e], [v for _, v in e]) for k, e in (("rook", rook), ("rook_turned", turned), ("shrikhande", shrikhande))]
    context = pipeline.Context(spark, pipeline.Config.of({"out": str(tmp_path), "dedup": mode}))
    pipeline._add(context, spark.createDataFrame(graphs, pipeline.GRAPHS.partition(", xs ")[0]))
    pipeline.STAGES["dedup"](context)
    assert {r.graph_id for r in context.table("manifest").read().collect()} == kept
    assert {r.dropped_graph_id for r in context.table("dedup_audit").read().collect()} == {"rook", "rook_turned", "shrikhande"} - kept
    assert context.table("manifest").read().filter(F.col("graph_id") == "rook").count() == 1


def test_unknown_mode():
    with pytest.raises(ValueError, match="dedup"):
        pipeline.Config.of({"out": "x", "dedup": "other"})
