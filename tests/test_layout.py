"""Neighbour graphs against all pairs, and layouts against numpy."""

import numpy as np
import pytest

from sightline.operators import layout


def plain_neighbours(x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]] for i in range(len(x))}


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centres = 3 * rng.normal(size=(3, 8))
    return centres[rng.integers(0, 3, 360)] + rng.normal(size=(360, 8))


@pytest.fixture(scope="module")
def graph(spark, cloud):
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(cloud)] + [(None, [1.0] * 8), (999, None), (998, [0.0] * 8)]
    return layout.neighbours(spark.createDataFrame(rows, "id long, vec array<double>").repartition(3), "id", "vec", 6)


def test_recall_of_neighbours(graph, cloud):
    want, got = plain_neighbours(cloud, 6), {}
    for r in graph.collect():
        got.setdefault(r.u, []).append(r.v)
    assert set(got) == set(range(360)) and all(len(v) == 6 for v in got.values())
    assert sum(len(set(got[u]) & set(want[u])) for u in want) / (6 * 360) >= 0.9


def test_layout_is_the_slowest_directions(spark, graph, cloud):
    rows = graph.collect()
    a = np.zeros((360, 360))
    for r in rows:
        a[r.u, r.v] = a[r.v, r.u] = 1
    d = np.sqrt(a.sum(1))
    values, vectors = np.linalg.eigh(0.5 * np.eye(360) + 0.5 * a / d[:, None] / d[None, :])
    first = layout.layout(graph, rounds=25).orderBy("id").collect()
    got = np.array([(r.x, r.y) for r in first]) * d[:, None]
    got /= np.linalg.norm(got, axis=0)
    # What is left outside the leading directions is small, and the constant one is gone.
    assert abs(got.T @ (d / np.linalg.norm(d))).max() < 1e-5
    speeds = [float(v @ (0.5 * v + 0.5 * (a / d[:, None] / d[None, :]) @ v)) for v in got.T]
    assert speeds[0] > values[-4] and speeds[1] > values[-6]
    assert [tuple(r) for r in layout.layout(graph, rounds=3).orderBy("id").collect()] == [tuple(r) for r in layout.layout(graph.repartition(7), rounds=3).orderBy("id").collect()]


def test_small_clouds(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert layout.neighbours(none, "id", "vec").count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    found = layout.neighbours(two, "id", "vec", 3)
    assert {(r.u, r.v) for r in found.collect()} == {(1, 2), (2, 1)}
    assert {(r.id, r.x, r.y) for r in layout.layout(found).collect()} == {(1, 0.0, 0.0), (2, 0.0, 0.0)}


def test_neighbours_are_those_of_all_pairs_across_blocks_and_tiles(spark):
    """Without clusters, with equal vectors, and with blocks and tiles far smaller than the table."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1100, 24))
    x[rng.integers(0, 1100, 200)] = x[7]
    x[40:90] = 2 * x[40]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<float>")
    found = layout.neighbours(rows, "id", "vec", 5, block=24 * 300, tile=(48, 96))
    got = {}
    for r in found.orderBy("u", "rank").collect():
        got.setdefault(r.u, []).append(r.v)
    assert got == plain_neighbours(x.astype(np.float32).astype(np.float64), 5)


def test_no_pair_of_points_is_a_row(spark):
    rows = spark.range(4096).selectExpr("id", "array(sin(id), cos(id * 1.7), sin(id * id)) AS vec")
    plan = layout.neighbours(rows, "id", "vec", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" in plan and "Join" not in plan  # vectors are not joined to pairs


def test_neighbours_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [float("nan"), 1.0]), (4, [1e-12, 0.0]), (5, [1.0, None]), (6, [1.0, 1.0, 1.0]), (7, []), (-8, [-1.0, 0.1])]
    found = layout.neighbours(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", 2)
    assert {(r.u, r["rank"]): r.v for r in found.collect()} == {(1, 1): 2, (1, 2): -8, (2, 1): 1, (2, 2): -8, (-8, 1): 2, (-8, 2): 1}
