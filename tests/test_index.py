"""The vector index against comparing all pairs; exact search in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import ranking, vector_index


def plain_top(items, queries, k):
    """items, queries: lists of (id, vector); ties by id."""
    ids = np.array([i for i, _ in items])
    unit = lambda rows: (x := np.array([v for _, v in rows], float)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    values = np.round(unit(queries) @ unit(items).T, 12)
    return {q: [int(ids[j]) for j in np.lexsort((ids, -row))[:k]] for (q, _), row in zip(queries, values)}


def listed(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.item)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    rows = centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    rows[:1000] = rows[0] + 0.01 * rng.normal(size=(1000, 24))  # a list that holds a third of all rows
    rows[1000:1040] = rows[0]  # equal vectors
    return [(k, [float(x) for x in v]) for k, v in enumerate(rows)]


@pytest.fixture(scope="module")
def tables(spark, vectors):
    rows = spark.createDataFrame(vectors, "id long, v array<double>").repartition(4)
    odd = spark.createDataFrame([(None, [1.0] * 24), (90_001, None), (90_002, [0.0] * 24)], "id long, v array<double>")
    return rows.union(odd), rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("vec"))


def test_blocks_equal_all_pairs(tables, vectors):
    rows, asked = tables
    want = plain_top(vectors, [v for v in vectors if v[0] % 20 == 0], 7)
    for item_block, query_block in ((16_384, 16_384), (100, 30)):
        found = ranking.block_top_k(rows.where("id < 90000"), asked, 7, "id", "v", item_block=item_block, query_block=query_block)
        assert listed(found) == want


def test_no_query_reaches_the_driver(spark, tables):
    found = ranking.block_top_k(tables[0], tables[1], 3, "id", "v")
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan


@pytest.fixture(scope="module")
def index(tables, tmp_path_factory):
    return vector_index.build(tables[0], "id", "v", str(tmp_path_factory.mktemp("index") / "ix"), vector_index.Settings(block=200, chunk=40))


def test_every_row_is_indexed(index):
    assert index.rows.select("item").distinct().count() == index.rows.count() == 3000
    sizes = {r["list"]: (r["size"], r["radius"]) for r in index.lists.collect()}
    assert sum(n for n, _ in sizes.values()) == 3000
    for r in index.rows.where("item % 50 = 0").collect():
        residual = np.array(r.vec) - index.centres[r["list"]]
        assert np.linalg.norm(residual) <= sizes[r["list"]][1] + 1e-9
        pieces = [index.scales[r["list"]] * b[c] for b, c in zip(index.codebooks, r.codes)]
        assert abs(np.linalg.norm(residual - np.concatenate(pieces)) - r.error) < 1e-9


def test_recall(index, tables, vectors):
    want = plain_top([v for v in vectors], [v for v in vectors if v[0] % 20 == 0], 10)
    got = listed(vector_index.search(index, tables[1], 10))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9


def test_exact_search(spark, index, tables, vectors):
    want = plain_top(vectors, [v for v in vectors if v[0] % 20 == 0], 10)
    assert listed(vector_index.search(index, tables[1], 10, visit=1, exact=True)) == want
    again = vector_index.open_index(spark, index.path, index.settings)
    far = spark.createDataFrame([(1, [-x for x in vectors[0][1]]), (2, [0.0] * 24), (None, [1.0] * 24), (3, None)], "qid long, vec array<double>")
    assert listed(vector_index.search(again, far, 5, visit=1, exact=True)) == plain_top(vectors, [(1, [-x for x in vectors[0][1]])], 5)


def test_exact_search_reads_less(index, tables):
    """Bounds leave lists out: a query near a tight cluster reads few of the others."""
    context, near = index.spark.sparkContext, tables[1].where("qid = 0")
    asked = vector_index._unit(near, "qid", "vec").select(F.col("item").alias("qid"), F.col("vec").alias("q"), F.lit(0.2).alias("reach"))
    radii = np.array([0.0] * len(index.centres))
    for r in index.lists.collect():
        radii[r["list"]] = r["radius"]
    within = asked.mapInArrow(vector_index._lists_within(context.broadcast(index.centres), context.broadcast(radii)), "qid long, q array<double>, reach double, list int")
    assert 0 < within.count() < len(index.centres)


def test_random_directions(spark):
    """No clusters at all, the worst case: the number of lists to visit grows so that the recall holds."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(1500, 32)))]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    from sightline.sources.tables import new_folder

    index = vector_index.build(table, "id", "v", new_folder(spark, "index"))
    asked = [r for r in rows if r[0] % 20 == 0]
    got = listed(vector_index.search(index, spark.createDataFrame(asked, "qid long, vec array<double>"), 10))
    want = plain_top(rows, asked, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9


def test_settings_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, v array<double>")
    with pytest.raises(ValueError):
        vector_index.build(empty, "id", "v", str(tmp_path / "x"))
    assert ranking.block_top_k(empty, spark.createDataFrame([], "qid long, vec array<double>"), 3, "id", "v").count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    index = vector_index.build(few, "id", "v", str(tmp_path / "few"))
    assert listed(vector_index.search(index, spark.createDataFrame([(5, [1.0, 1.0])], "qid long, vec array<double>"), 5, exact=True)) == {5: [1, 2]}


def test_racks_give_k_rows_a_query_on(spark, tables, vectors, index):
    """Racks of a few lists and small chunks: the exact result is that of all pairs, and candidates are not shuffled."""
    from dataclasses import replace

    small = replace(index, settings=replace(index.settings, rack=400, chunk=30))
    want = plain_top(vectors, [v for v in vectors if v[0] % 20 == 0], 10)
    assert listed(vector_index.search(small, tables[1], 10, exact=True)) == want
    found = vector_index.search(small, tables[1], 10)
    got = listed(found)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroups") == 1 and plan.count("Join") == 1  # with the table of lists
