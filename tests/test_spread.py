"""Joins that give far more rows than they read are spread over tasks, whatever their keys, and lose no row."""

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import filters
from sightline.plans import retrieval, search


def _tasks(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_windows_of_one_video_are_judged_in_several_tasks(spark):
    windows = spark.range(400).selectExpr("'v' AS video", "id AS window", "'' AS day", "id * 1.0D AS start", "id + 2.0D AS end", "array('T' || id % 3) AS tags")
    limits = "IF(id % 5 = 0, NULL, named_struct('query_date', 'DAY1', 'query_time_sec', 5.0D, 'allowed_days', array('DAY1'), 'ranges', array(named_struct('s', id % 2 * 100.0D, 'e', 150.0D)), 'relation', 'unrestricted'))"
    asked = spark.range(60).selectExpr("id AS qid", "'v' AS video", f"{limits} AS c", "IF(id % 4 = 0, array(), array('t1')) AS wanted")
    found = filters.windows_met(windows, asked)
    expected = {
        (q, w) for q in range(60) for w in range(400)
        if (q % 4 == 0 or w % 3 == 1) and (q % 5 == 0 or (w + 2 >= q % 2 * 100 and w <= 150))
    }
    rows = [(r.qid, r.window) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert _tasks(found) > 4


def test_pairs_of_one_tag_come_from_several_tasks(spark):
    rows = spark.range(300).selectExpr("id AS item", "array('a', IF(id % 2 = 0, 'B', NULL), 'A') AS tags")
    wanted = spark.range(40).selectExpr("id AS qid", "IF(id % 3 = 0, array('A', 'b'), IF(id % 3 = 1, array('B'), array())) AS wanted")
    found = filters.sharing_a_tag(rows.union(rows.where("item = 8")), wanted)
    pairs = [(r.qid, r.item) for r in found.collect()]
    expected = [(q, i) for q in range(40) for i in [*range(300), 8] if q % 3 == 0 or (q % 3 == 1 and i % 2 == 0)]
    assert sorted(pairs) == sorted(expected)  # a row that is given twice counts twice, as in a join
    assert _tasks(found) > 4


def test_scenes_of_one_video_meet_their_queries_in_blocks(spark):
    rng = np.random.default_rng(5)
    vecs, asks = rng.normal(size=(90, 4)), rng.normal(size=(30, 4))
    items = spark.createDataFrame([("v", i, "a", v.tolist()) for i, v in enumerate(vecs)], "video string, ord long, modality string, vec array<double>")
    queries = spark.createDataFrame([(q, "a", v.tolist()) for q, v in enumerate(asks)], "qid long, modality string, vec array<double>")
    chosen = spark.range(30).selectExpr("id AS qid", "'v' AS video", "1 AS video_rank")
    found = retrieval.best_in_videos(items, "ord", chosen, queries, 3, item_block=16, query_block=8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = np.argsort(-(unit(asks) @ unit(vecs).T), axis=1)[:, :3]
    got = {(r.qid, r["rank"]): r.place for r in found.collect()}
    assert got == {(q, n + 1): int(expected[q, n]) for q in range(30) for n in range(3)}
    counted = retrieval.top_scenes(items, chosen, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in counted  # pairs of queries and scenes are no rows


def test_windows_in_blocks_obey_what_the_filter_says(spark):
    windows = spark.range(60).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 'DAY1', 'day2')) AS day", "IF(id % 7 = 0, NULL, id * 10.0D) AS start", "id * 10.0D + 25 AS end", "array('T' || id % 4, NULL) AS tags", "id AS w")
    limits = """IF(id % 9 = 0, NULL, named_struct('query_date', IF(id % 4 = 0, NULL, 'DAY2'), 'query_time_sec', IF(id % 5 = 0, NULL, id * 9.0D), 'allowed_days', IF(id % 3 = 0, array('DAY1'), IF(id % 3 = 1, array('DAY1', NULL), array())),
      'ranges', IF(id % 2 = 0, array(named_struct('s', id * 5.0D, 'e', id * 5.0D + 100)), array()), 'relation', element_at(array('before_query_time', 'after_query_time', 'unrestricted'), CAST(id % 3 + 1 AS INT))))"""
    asked = spark.range(50).selectExpr("id AS q", f"CAST({limits} AS {search.CONSTRAINTS}) AS c", "IF(id % 2 = 0, array(), array('t1')) AS wanted")
    passes = filters.in_window(F.col("day"), F.col("start"), F.col("end"), F.col("c")) & filters.shares_tag(F.col("tags"), F.col("wanted"))
    expected = {(r.q, r.w) for r in windows.crossJoin(asked).where(passes).select("q", "w").collect()}
    met = search._met(windows.orderBy("w").coalesce(1).toArrow(), asked.orderBy("q").coalesce(1).toArrow())
    assert {(int(q), int(w)) for q, w in zip(*np.nonzero(met))} == expected and 0 < len(expected) < 3000
