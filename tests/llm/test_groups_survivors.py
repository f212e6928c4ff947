"""Problems 1 and 2 against plain Python on small and dirty tables."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from graphmill import scale
from graphmill.llm import components, survivors

LINKS = "a string, b string, extra int, u string"


def closure(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return sorted((find(x), x) for x in root)


def grouped(spark, links):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in links], LINKS)
    return sorted(tuple(r) for r in components.connected_groups(df, "a", "b").collect())


@pytest.mark.parametrize("links", [
    [],
    [(None, "a"), ("a", None), ("b", "b")],
    [("a", "b"), ("b", "a"), ("a", "b"), ("c", "b"), ("d", "e"), ("", "z")],
    [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)],
    [("hub", f"m{i:03d}") for i in range(50)] + [(f"m{i:03d}", f"z{i:03d}") for i in range(50)],
])
def test_groups(spark, links):
    assert grouped(spark, links) == closure(links)


def test_groups_random_with_hot_names(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 20)
    rnd = random.Random(5)
    links = [(f"é{rnd.randrange(90)}", f"q{rnd.randrange(90)}") for _ in range(70)] + [("hub", f"q{i}") for i in range(0, 90, 3)]
    assert grouped(spark, links) == closure(links)


MANIFEST = "row_id long, graph_id string, generator string, category string, source string, generated_at_utc timestamp, prop_hash string, trust string"
SOURCES = "source string, trust int, category string"
T1, T2 = datetime(2021, 1, 1), datetime(2021, 1, 2)


def tables(spark, rows, sources=(("S1", 3, None), ("s2", None, None), (None, 9, None))):
    return spark.createDataFrame([(*r, "clash") for r in rows], MANIFEST), spark.createDataFrame(list(sources), SOURCES)


def test_winner_must_be_best_in_all(spark):
    rows = [
        (1, "a", "g", "c", " s1\t", T2, "h1"), (2, "a", "g", None, "S1", T2, "h1"),
        (3, "b", "g", "c", "S1", T1, "h2"), (4, "b", "g", "c", "S1", T2, "h2"), (5, "b", "g", "c", "S1", T2, "h2"),
        (6, "c", "g", "c", "s2", T2, "h3"), (7, "c", "N/A", "c", "S1", T2, "h3"),
        (8, "d", "g", "c", "S1", T2, "h4"),
        (9, "e", "g", "c", "S1", None, None), (10, "e", "g", "c", "S1", T1, None),
        (11, "f", "g", "c", "S1", None, "h5"), (12, "f", "?", " ", "nan", None, "h5"),
    ]
    got = survivors.clear_winners(*tables(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [("h1", 1), ("h5", 11)]


def test_survivor_is_filled_field_by_field(spark):
    rows = [
        (1, "a", "unknown", "c", "S1", T1, "h"), (2, "b", "g2", "None", "s2", T2, "h"), (3, "c", "g3", None, "S1", T1, "h"),
        (4, "d", "g", "c", "nope", T1, None), (5, None, None, None, None, None, "n"), (6, None, None, None, None, None, "n"),
    ]
    got = {r.row_id: r for r in survivors.survivors(*tables(spark, rows)).collect()}
    assert set(got) == {1, 4, 5}
    assert (got[1].graph_id, got[1].generator, got[1].category, got[1].source, got[1].n_rows) == ("a", "g3", "c", "S1", 3)
    assert got[5].category is None and got[5].n_rows == 2 and got[4].n_rows == 1


def test_empty_tables(spark):
    assert survivors.clear_winners(*tables(spark, [], [])).count() == 0
    assert survivors.survivors(*tables(spark, [], [])).count() == 0
