"""Interval operators whose windows end at ranges of time, values of principal components, blocks of softmax."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import catalogue
from sightline.operators import intervals, pooling, ranking, scenes

from .oracle import DATA


def plain_merge(rows, most, least):
    out, group = [], []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if group and (len(group) == most or not 0 <= r[2] - group[-1][3] <= 1.0):
            out.append(group)
            group = []
        group.append(r)
    out += [group] if group else []
    return [g for run in out for g in ([run] if len(run) >= least else [[r] for r in run])]


@pytest.mark.parametrize("width", [7.0, 55.0, 3600.0])
def test_merging_over_borders(spark, width):
    rng = random.Random(width)
    rows, want = [], []
    for v in (None, "a", "b"):
        t, mine = 0.0, []
        for k in range(60):
            t += rng.choice([10.0, 10.0, 10.5, 11.0, 12.5, 9.0, 200.0])
            mine.append((v, k, t, t + 10.0, rng.choice([None, rng.random()])))
        rows += mine
        for least, most in ((2, 5),):
            for g in plain_merge(mine, most, least):
                scores = [r[4] for r in g if r[4] is not None]
                want.append((v or "", g[0][2], g[-1][3], "_".join(str(r[1]) for r in g), len(g), max(scores, default=None)))
    df = spark.createDataFrame(rows, "video string, scene int, start double, end double, score double").repartition(3)
    got = [(r.video or "", r.start, r.end, r.scenes, r.n, r.score) for r in intervals.merge_consecutive(df, ["video"], width=width).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    means = {(r.video or "", r.start): r.score for r in intervals.merge_consecutive(df, ["video"], width=width, how="avg").collect()}
    for (v, s, *_), g in zip(sorted(want, key=str), sorted(want, key=str)):
        assert (v, s) in means


@pytest.mark.parametrize("width", [3.0, 40.0])
def test_clip_ends_over_borders(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), k, float(rng.randrange(200))) for k in range(80)]
    got = {r.id: (r.ord, r.end) for r in intervals.clip_ends(spark.createDataFrame(rows, "v string, id int, start double"), ["v"], order=["id"], width=width).collect()}
    for v in ("a", None):
        mine = sorted((s, k) for w, k, s in rows if w == v)
        for n, (s, k) in enumerate(mine):
            end = mine[n + 1][0] - 1.0 if n + 1 < len(mine) else None
            assert got[k] == (n, end if end is not None and end > s else s + 30.0)


@pytest.mark.parametrize("width", [2.0, 30.0, 3600.0])
def test_asof_over_borders(spark, width):
    rng = random.Random(width)
    clips = [(rng.choice(["a", "b", None]), float(rng.randrange(300))) for _ in range(40)] + [("a", None)]
    targets = [(rng.choice(["a", "b", None, "none"]), k, rng.choice([None, float(rng.randrange(-20, 320))])) for k in range(90)]
    got = intervals.asof(spark.createDataFrame(targets, "p string, id int, at double"), spark.createDataFrame(clips, "p string, start double"), ["p"], width=width).collect()
    assert len(got) == len(targets)
    for r in got:
        mine = [s for p, s in clips if p == r.p and s is not None]
        before = [s for s in mine if r.at is not None and s <= r.at]
        assert r.start == (max(before) if before else min(mine, default=None))


def test_windows_have_ranges_in_their_keys(spark):
    """No window over rows is by the key alone: what is, is over one row a range."""
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0, 0.1)], "video string, scene int, start double, end double, score double")
    for made in (intervals.merge_consecutive(rows, ["video"]), intervals.clip_ends(rows, ["video"]), intervals.asof(rows.select("video", F.col("start").alias("at")), rows.select("video", "start"), ["video"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.split("\n") if "Window [" in x):
            keys = line.split("], [")[1]
            assert "_b#" in keys or "_n#" in line or "_top#" in line or "_s#" in line or "_low#" in line, line


def plain_principal(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(values)[::-1]
    return values[order[:k]] / values.sum(), vectors[:, order[:k]]


def test_pca_variance_equals_numpy(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()], float)
    want, _ = plain_principal(x, 5)
    got = catalogue.pca_variance(spark, DATA).orderBy("component").collect()
    assert [r.explained for r in got] == pytest.approx(want.tolist(), abs=2e-6) and got[-1].cumulative == pytest.approx(want.sum(), abs=1e-5)


def test_shared_space_equals_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=(40, 6)) * [5, 3, 1, 1, 1, 1], "b": rng.normal(size=(30, 3))}
    rows = [(k, g, [float(v) for v in x]) for g, xs in groups.items() for k, x in enumerate(xs)] + [(99, "a", None)]
    found = pooling.shared_space(spark.createDataFrame(rows, "id int, modality string, vec array<double>"), ["id"], 4).collect()
    got = {(r.modality, r.id): np.array(r.vec) for r in found}
    assert len(got) == 70
    for g, xs in groups.items():
        unit = xs / np.linalg.norm(xs, axis=1, keepdims=True)
        _, axes = plain_principal(unit, 4)
        turned = unit @ axes
        own = np.stack([got[g, k] for k in range(len(xs))])
        wide = turned.shape[1]
        signs = np.sign((own[:, :wide] * turned).sum(0))
        assert np.allclose(own[:, :wide], turned * signs, atol=1e-8) and np.allclose(own[:, wide:], 0)


def test_softmax_in_blocks(spark):
    rng = np.random.default_rng(6)
    items = [(k, "big" if k % 5 else "small", [float(x) for x in rng.normal(size=4)]) for k in range(200)]
    asked = [r for r in items if r[0] % 7 == 0] + [(1000, "nowhere", [1.0] * 4)]
    a, b = spark.createDataFrame(items, "item long, g string, vec array<double>"), spark.createDataFrame(asked, "qid long, g string, vec array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for blocks in ((16_384, 16_384), (9, 4)):
        got = {}
        for r in ranking.softmax_top_k(a, b, "g", 3, *blocks).collect():
            got.setdefault(r.qid, {})[r["rank"]] = (r.item, round(r.probability, 9))
        for q, g, v in asked:
            scored = sorted(((-float(np.round(unit(v) @ unit(x), 12)), i) for i, h, x in items if h == g))
            total = sum(np.exp(-s) for s, _ in scored)
            assert got.get(q, {}) == {n + 1: (i, round(float(np.exp(-s) / total), 9)) for n, (s, i) in enumerate(scored[:3])}


def test_window_texts_fall_back(spark):
    places = spark.createDataFrame([("v", w, o) for w, os in enumerate([(0, 1), (2, 3), (4,), (9,)]) for o in os], "video string, window int, ord int")
    held = [("v", 0, "b", [1.0]), ("v", 1, "a", None), ("v", 2, "", [2.0]), ("v", 3, None, [4.0]), ("v", 4, None, None)]
    got = {r.window: (r.texts, r.text, r.vec) for r in scenes.window_texts(places, spark.createDataFrame(held, "video string, ord int, text_raw string, vec array<double>")).collect()}
    assert got == {0: (["b", "a"], "b\na", None), 1: ([], scenes.POOLED, [3.0]), 2: ([], "", None), 3: ([], "", None)}
