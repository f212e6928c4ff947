"""The queries of layouts and drawings over the whole corpus and catalogue."""

from __future__ import annotations

import numpy as np
import pytest

from graphmill.functions import generators, layouts
from graphmill.plans import q_more


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(o, p) for o in range(6) for p in (o, o + 1, o + 2, 31)], "l_orderkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(o, 7 + o % 2) for o in range(6)], "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    return at


@pytest.mark.parametrize(("query", "n_layouts"), [(q_more.layout_baur_brandes, 2), (q_more.layout_planar_layered, 2), (q_more.layout_forces, 3), (q_more.drawings_svg, 2)])
def test_every_graph_is_laid_out(spark, sf, query, n_layouts):
    got = query(spark, sf).select("graph_id", "layout", "outcome").collect()
    want = {"7", "8", *(f"calibration_{k}_n{g[0]:03d}_m{len(g[1]):04d}.graphml" for k, g in generators.calibration())}
    assert len(want) == 86 and {r.graph_id for r in got} == want and len(got) == 86 * n_layouts
    assert {r.outcome for r in got if r.layout != "planar"} == {"ok"} and {r.outcome for r in got} <= {"ok", "not_applicable"}


def crossings(seq, x, n, us, vs):
    at = {y: i for i, y in enumerate(seq)}
    own = {at[b if a == x else a] for a, b in zip(us, vs, strict=True) if x in (a, b)}
    total = 0
    for a, b in zip(us, vs, strict=True):
        if x not in (a, b):
            p, q = sorted(((at[a] - at[x]) % n, (at[b] - at[x]) % n))
            total += sum(p < (o - at[x]) % n < q for o in own)
    return total


def sifted(order, n, us, vs):
    for x in list(order):
        rest = [y for y in order if y != x]
        order = min((rest[:i] + [x] + rest[i:] for i in range(n)), key=lambda s: (crossings(s, x, n, us, vs), s.index(x)))
    return order


def order_of(n, us, vs, rounds):
    xy = layouts.baur_brandes(n, us, vs, rounds=rounds)[0]
    return np.argsort(np.arctan2(xy[:, 1], xy[:, 0]) % (2 * np.pi)).tolist()


@pytest.mark.parametrize("seed", range(12))
def test_sifting_equals_counting_every_place(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(3, 11))
    i, j = np.triu_indices(n, 1)
    c = np.sort(r.choice(len(i), int(r.integers(1, len(i) + 1)), replace=False))
    us, vs = i[c].astype(np.int64), j[c].astype(np.int64)
    assert order_of(n, us, vs, 1) == sifted(order_of(n, us, vs, 0), n, us.tolist(), vs.tolist())


def test_large_graphs_are_sifted_as_often():
    n, us, vs = dict(generators.calibration())["grid_7x7"]
    count = lambda rounds: sum(crossings(order_of(n, us, vs, rounds), x, n, us.tolist(), vs.tolist()) for x in range(n))
    assert n > 40 and count(10) < count(1)
