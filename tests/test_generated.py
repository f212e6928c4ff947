"""As many generated graphs as were asked for, whatever the yield."""

from __future__ import annotations

import pytest

from graphmill.operators import generate


def test_low_yield_loses_no_graph(spark):
    got = [tuple(r) for r in generate.generated(spark, 60, families=["hrg"]).select("graph_id", "seed").collect()]
    assert len(set(got)) == len(got) == 60
    ok = generate.draws(spark, 2000, families=["hrg"]).filter("valid").orderBy("draw").limit(60).collect()
    assert [seed for _, seed in got] == [r.seed for r in ok]


def test_shortfall_is_reported(spark, monkeypatch):
    monkeypatch.setattr(generate, "FRUITLESS", 300)
    with pytest.warns(UserWarning, match="0 of 5 graphs"):
        assert generate.generated(spark, 5, families=["no such family"]).count() == 0
    assert generate.generated(spark, 0).count() == 0
