"""Content-based scenes and grouped k-means against plain versions."""

import numpy as np
import pytest

from sightline.operators import changes, clusters


def plain_scenes(x, s):
    n = len(x)
    if n < s.least:
        return [(0, n)]
    costs, best, begin = changes.Costs(x, 0, s.penalty), [0.0] + [np.inf] * n, [-1] * (n + 1)
    for t in range(1, n + 1):
        for q in range(max(0, t - s.most), t - s.least + 1):
            value = best[q] + float(costs.of(q, q + 1, t)[0])
            if value < best[t]:
                best[t], begin[t] = value, q
    out, t = [], n
    while t > 0:
        out.append((begin[t], t))
        t = begin[t]
    return out[::-1]


def all_partitions(n, least, most):
    if n == 0:
        return [[]]
    return [[*rest, (n - k, n)] for k in range(least, min(most, n) + 1) for rest in all_partitions(n - k, least, most)]


def test_cheapest_of_all_partitions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(4, 11))
        x, s = rng.normal(size=(n, 2)), changes.Settings(penalty=float(rng.choice([0.2, 1.0])), least=2, most=5, width=5)
        costs = changes.Costs(x, 0, s.penalty)
        total = lambda p: sum(float(costs.of(a, a + 1, b)[0]) for a, b in p)
        assert abs(total(plain_scenes(x, s)) - min(map(total, all_partitions(n, 2, 5)))) < 1e-6
        near = sum(((x[a:b] - x[a:b].mean(0)) ** 2).sum() + s.penalty for a, b in plain_scenes(x, s))
        assert abs(near - total(plain_scenes(x, s))) < 1e-6


@pytest.mark.parametrize("width", [8, 19, 4096])
def test_borders_change_nothing(spark, width):
    rng = np.random.default_rng(width)
    s = changes.Settings(penalty=0.6, least=2, most=8, width=width)
    videos = {f"v{k}": rng.normal(size=(n, 3)) for k, n in enumerate([1, 2, 3, 8, 16, 57, 130])}
    videos["steady"] = np.ones((40, 3))
    videos["steps"] = np.repeat(rng.normal(size=(12, 3)), 5, axis=0)
    rows = [(v, k, [float(y) for y in x]) for v, xs in videos.items() for k, x in enumerate(xs)]
    got = {}
    for r in sorted(changes.content_scenes(spark.createDataFrame(rows, "video string, place int, vec array<double>").repartition(3), s).collect(), key=lambda r: (r.video, r.scene)):
        got.setdefault(r.video, []).append((r.scene, r.first, r.after))
    assert got == {v: [(n, *p) for n, p in enumerate(plain_scenes(x, s))] for v, x in videos.items()}
    assert [a for _, a, _ in got["steps"]] == list(range(0, 60, 5))


def test_no_video(spark):
    assert changes.content_scenes(spark.createDataFrame([], "video string, place long, vec array<float>")).count() == 0
    with pytest.raises(ValueError):
        changes.Settings(least=5, most=9)


def plain_kmeans(rows, per, most, rounds):
    """rows: (id, vector) of a group, by id; {id: cluster}, centres."""
    x = np.array([v for _, v in rows])
    ids = [i for i, _ in rows]
    k = min(len(rows) // per + 1, most)
    centres = [x[0]]
    square = lambda: np.round(((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2), 9)
    while len(centres) < k:
        away = square().min(1)
        if away.max() <= 0:
            break
        centres.append(x[min(range(len(x)), key=lambda r: (-away[r], ids[r]))])
    for _ in range(rounds):
        nearest = square().argmin(1)
        centres = [np.round(x[nearest == c].mean(0), 9) if (nearest == c).any() else old for c, old in enumerate(centres)]
    d = square()
    return {i: (int(c), float(d[r, c])) for r, (i, c) in enumerate(zip(ids, d.argmin(1)))}


def test_grouped_kmeans(spark):
    rng = np.random.default_rng(2)
    groups = {"a": 60, "b": 17, "c": 7, "d": 1, "same": 20}
    rows = {g: [(i, [float(y) for y in (rng.normal(size=4) if g != "same" else np.ones(4))]) for i in range(n)] for g, n in groups.items()}
    flat = [(g, i, v) for g, vs in rows.items() for i, v in vs] + [(None, 1, [1.0] * 4), ("a", None, [1.0] * 4), ("a", 999, None)]
    found = clusters.grouped_kmeans(spark.createDataFrame(flat, "g string, i long, v array<double>").repartition(3), "g", "i", "v", per=8, most=5, rounds=6)
    got = {}
    for r in found.collect():
        got.setdefault(r.g, {})[r.i] = (r.cluster, r.distance)
    for g, vs in rows.items():
        want = plain_kmeans(vs, 8, 5, 6)
        assert {i: c for i, (c, _) in got[g].items()} == {i: c for i, (c, _) in want.items()}
        assert all(abs(got[g][i][1] - d) < 1e-6 for i, (_, d) in want.items())
    assert len({c for c, _ in got["a"].values()}) == 5 and {c for c, _ in got["same"].values()} == {0}
    medoids = {(r.g, r.cluster): (r.medoid, r.n) for r in clusters.medoids(found, "g", "i").collect()}
    for (g, c), (medoid, n) in medoids.items():
        members = {i: d for i, (k, d) in got[g].items() if k == c}
        assert n == len(members) and medoid == min(members, key=lambda i: (members[i], i))


def test_no_clusters(spark):
    assert clusters.grouped_kmeans(spark.createDataFrame([], "g string, i long, v array<double>"), "g", "i", "v").count() == 0
