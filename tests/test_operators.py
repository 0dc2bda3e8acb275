import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import texts, times, vectors
from sightline.operators import filters, intervals, metrics, pooling, ranking, tagging
from sightline.plans import planner
from sightline.sources import annotations, encoders, views
from sightline.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "seconds"), [("DAY2_A4_MAPLE_11300000", 41400.0), ("DAY5_A3_BIRCH_14453000", 53130.0), ("DAY6_A2_CEDAR_22200000", 80400.0), ("x", None)])
def test_clip_start(spark, name, seconds):
    assert one(spark, times.clip_start(F.lit(name))) == seconds


@pytest.mark.parametrize(("text", "seconds"), [("11210217", 40862.17), ("12345", 0.0), ("aabbcc00", 0.0), ("112102", 40862.0)])
def test_time_seconds(spark, text, seconds):
    assert one(spark, times.time_seconds(F.lit(text))) == pytest.approx(seconds)


def test_names(spark):
    parts = one(spark, times.clip_parts(F.lit("DAY2_A1_OLD_OAK_10000000")))
    assert (parts.day, parts.person, parts.who, parts.time) == ("DAY2", "A1", "OLD_OAK", "10000000")
    assert one(spark, times.stem(F.lit("/a/b/DAY1_x.y.mp4"))) == "DAY1_x.y"
    assert one(spark, times.shifted_day(F.lit("DAY7"), 1)) == []
    assert one(spark, times.shifted_day(F.lit("day2"), -1)) == ["DAY1"]


def test_scaled_ranges(spark):
    given = [(8, 12), (60, 120), (21, 24), (3600, 7200), (5, 5)]
    ranges = F.array(*(F.struct(F.lit(float(a)).alias("s"), F.lit(float(b)).alias("e")) for a, b in given))
    assert [tuple(r) for r in one(spark, times.scaled_ranges(ranges))] == [(28800, 43200), (3600, 7200), (1260, 1440), (3600, 7200)]


def test_iou(spark):
    iou = lambda *x, **k: one(spark, times.interval_iou(*map(F.lit, map(float, x)), **k))
    assert iou(0, 10, 5, 15) == pytest.approx(1 / 3)
    assert iou(0, 10, 5, 15, by_truth=True) == 0.5
    assert iou(5, 5, 0, 10) == 0


@pytest.mark.parametrize(("reply", "letter"), [("B. because", "B"), ("The answer is c", "C"), ("none", ""), ("The answer is a cat", "A")])
def test_choice_letter(spark, reply, letter):
    assert one(spark, texts.choice_letter(F.lit(reply))) == letter


def test_question_text(spark):
    assert one(spark, texts.question_text(F.lit("T"), F.lit("Q"), [F.lit("x"), F.lit(""), F.lit("y")])) == "T. Q Choices: x, y"
    assert one(spark, texts.question_text(F.lit(""), F.lit("Q"))) == "Q"
    assert one(spark, texts.answer_part(F.lit("prompt ASSISTANT: yes\n-----\nx"))) == "yes"
    assert one(spark, texts.tags_in_reply(F.lit("Cooking and a Cup"), ["cup", "cook", "dog"])) == ["cup", "cook"]


@pytest.mark.parametrize(("reply", "fixed"), [('```json {"a": 24*60, "b": None,} ```', '{"a": 1440, "b": null}'), ("no object", None), ('x {"u": "http://a", "t": True // yes\n}', '{"u": "http://a", "t": true}'), (None, None)])
def test_repair_json(reply, fixed):
    assert texts.repair_json(reply) == fixed


def test_scores_of_texts():
    assert texts.rouge_l("the cat sat", "the cat sat") == 1.0
    assert texts.rouge_l("a b c d", "a x c y") == 0.5
    assert texts.bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1.0)
    assert texts.bleu("", "x") == texts.rouge_l("", "x") == 0.0


def test_zero_vector(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(zero, unit)) == 0.0
    assert one(spark, vectors.pad_or_cut(unit, 3)) == [1.0, 0.0, 0.0]
    assert one(spark, vectors.even_indices(F.lit(0), F.lit(9), 4)) == [0, 3, 6, 9]


def test_rank_fusion(spark):
    rows = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.5), (1, "b", "y", 0.4), (1, "b", "z", 0.1)], "qid int, modality string, item string, score double")
    ranked = ranking.top_k(rows, ["qid", "modality"], [F.desc("score")])
    got = {r.item: r.score for r in ranking.rrf(ranked, ["qid", "item"]).collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 61, 9), "z": round(1 / 62, 9)}
    fused = {r.item: r.score for r in ranking.fuse_scores(rows.where("item <> 'z'"), ["qid", "modality"], ["qid", "item"]).collect()}
    assert fused == {"x": 1.0, "y": 0.5}


def test_windows(spark):
    scenes = spark.createDataFrame([("v", i) for i in range(6)] + [("w", i) for i in range(3)], "video string, ord int")
    assert sorted((r.window, r["first"], r.n_scenes) for r in intervals.scene_windows(scenes).where("video = 'v'").collect()) == [(0, 0, 3), (1, 2, 3), (2, 3, 3)]
    assert [(r["first"], r.n_scenes) for r in intervals.scene_windows(scenes, size=5).where("video = 'w'").collect()] == [(0, 3)]


def test_merge(spark):
    scenes = spark.createDataFrame([("v", i, 10.0 * i, 10.0 * i + 10, float(i)) for i in [0, 1, 2, 3, 4, 5, 6, 9, 20, 21]], "video string, scene int, start double, end double, score double")
    got = sorted(r.scenes for r in intervals.merge_consecutive(scenes, ["video"]).collect())
    assert got == sorted(["0_1_2_3_4", "5_6", "9", "20_21"])


def test_merge_against_loop(spark):
    rng = random.Random(3)
    rows, expected = [], []
    for v in range(6):
        t, scenes = 0.0, []
        for k in range(25):
            t += rng.choice([10.0, 10.5, 11.0, 12.5, 9.0])
            scenes.append((f"v{v}", k, t, t + 10.0, rng.random()))
        rows += scenes
        group = []
        for s in scenes:
            if group and (len(group) == 5 or not 0 <= s[2] - group[-1][3] <= 1.0):
                expected.append((group[0][0], "_".join(str(g[1]) for g in group)))
                group = []
            group.append(s)
        expected.append((group[0][0], "_".join(str(g[1]) for g in group)))
    df = spark.createDataFrame(rows, "video string, scene int, start double, end double, score double")
    assert sorted((r.video, r.scenes) for r in intervals.merge_consecutive(df, ["video"]).collect()) == sorted(expected)


def test_split(spark):
    rows = spark.createDataFrame([(1, 70.2), (2, 70.4), (3, 20.0), (4, 0.0)], "k int, d double")
    got = intervals.fixed_split(rows, "k", F.col("d")).groupBy("k").agg(F.count("*").alias("n"), F.max("end").alias("e")).collect()
    assert {r.k: (r.n, r.e) for r in got} == {1: (2, 70.0), 2: (3, 70.4), 3: (1, 20.0)}


def test_clip_ends(spark):
    rows = spark.createDataFrame([("v", 1, 41400.0), ("v", 2, 41430.0), ("v", 3, 41430.0)], "video string, id int, start double")
    assert sorted((r.ord, r.end) for r in intervals.clip_ends(rows, ["video"], order=["id"]).collect()) == [(0, 41429.0), (1, 41460.0), (2, 41460.0)]


def test_asof(spark):
    clips = spark.createDataFrame([("p", 5.0), ("p", 20.0)], "person string, start double")
    targets = spark.createDataFrame([("p", 10.0), ("p", 25.0), ("p", 1.0), ("q", 3.0)], "person string, at double")
    assert sorted((r.person, r.at, r.start) for r in intervals.asof(targets, clips, ["person"]).collect()) == [("p", 1.0, 5.0), ("p", 10.0, 5.0), ("p", 25.0, 20.0), ("q", 3.0, None)]


def test_overlap_join(spark):
    rng = random.Random(5)
    left = [(rng.randrange(3), i, s := rng.uniform(0, 500), s + rng.uniform(0, 90)) for i in range(60)]
    right = [(rng.randrange(3), i, s := rng.uniform(0, 500), s + rng.uniform(0, 90)) for i in range(60)]
    a = spark.createDataFrame(left, "k int, x int, start double, end double")
    b = spark.createDataFrame(right, "k int, y int, r_start double, r_end double")
    got = sorted((r.x, r.y) for r in intervals.overlap_join(a, b, ["k"], 40.0).collect())
    assert got == sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and p[3] >= q[2] and p[2] <= q[3])


def test_fall_back(spark):
    rows = spark.createDataFrame([(1, "DAY1"), (1, "DAY2"), (2, "DAY1"), (2, "DAY9")], "qid int, day string")
    got = sorted((r.qid, r.day) for r in filters.keep_or_fall_back(rows, ["qid"], F.col("day") == "DAY9").collect())
    assert got == [(1, "DAY1"), (1, "DAY2"), (2, "DAY9")]


def test_pooling_skips_nulls(spark):
    rows = spark.createDataFrame([("v", [1.0, 3.0], ["b"]), ("v", None, None), ("v", [3.0, 5.0], ["a", "b"])], "video string, vec array<double>, tags array<string>")
    assert pooling.mean_vectors(rows, ["video"]).first().vec == [2.0, 4.0]
    assert pooling.tag_union(rows, ["video"]).first().tags == ["a", "b"]


def test_boost(spark):
    scores = spark.createDataFrame([(1, "act_chopping", 0.2), (1, "act_stirring", 0.2), (2, "act_stirring", 0.2)], "item int, tag string, score double")
    groups = spark.createDataFrame([("cooking", "act_chopping"), ("cooking", "act_stirring")], "grp string, tag string")
    got = sorted((r.item, r.tag, round(r.boosted, 9)) for r in tagging.co_occurrence(scores, groups).collect())
    assert got == [(1, "act_chopping", 0.22), (1, "act_stirring", 0.22), (2, "act_stirring", 0.2)]


def test_adjusted_rank(spark):
    queries = spark.createDataFrame([(1,), (2,)], "qid int")
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.5), (1, 4, 0.1), (1, 5, 0.0), *((2, k, 0.0) for k in range(1, 6))], "qid int, rank int, iou double")
    assert {r.qid: r.value for r in metrics.per_query(queries, rows, metrics.adjusted_rank()).collect()} == {1: 2.0, 2: 6.0}


def sentences(spark):
    """Questions with their date and time."""
    rows = [
        (1, "Yesterday morning somebody spoke about a boat, who?", "DAY4", 54000.0, False),
        (2, "Is there anything left to carry this afternoon?", "DAY2", 32400.0, False),
        (3, "The red folder, I saw it earlier today", "DAY5", 61200.0, False),
        (4, "The color of the lamp on day 3 and day3 at lunch", "DAY1", None, None),
        (5, "List the events of the day before", "DAY1", 100.0, True),
        (6, "Show the next day at dawn", "DAY7", 20000.0, False),
        (8, "anything", None, 5.0, None),
        (11, "", "DAY3", 0.0, False),
        (12, "tonight or tomorrow night", "DAY3", 70000.0, False),
    ]
    return spark.createDataFrame(rows, "qid long, query_text string, query_date string, query_time_sec double, need_audio boolean")


def test_plans(spark):
    plans = {r.qid: r.plan for r in planner.plan(sentences(spark)).collect()}
    first, second, third = plans[1], plans[2], plans[3]
    assert (first.allowed_days, first.time_of_day, first.relation, first.use_windows) == (["DAY3"], "morning", "unrestricted", False)
    assert [tuple(r) for r in first.time_ranges] == [(18000, 43200)]
    assert (second.allowed_days, second.time_of_day, second.relation) == (["DAY2"], "afternoon", "after_query_time")
    assert (third.allowed_days, third.time_ranges, third.relation) == (["DAY5"], [], "before_query_time")
    assert plans[4].allowed_days == ["DAY3"] and plans[5].allowed_days == [] and plans[5].relative_day == "previous"
    assert plans[2].workflow == ["day_filter", "time_range_filter", "after_query_time_filter", "video_retrieval", "scene_retrieval", "temporal_rerank"]
    days = spark.createDataFrame([("yesterday", "DAY1"), ("the other day", "DAY2"), ("x", "DAY2"), ("yesterday", "DAY3")], "t string, d string")
    assert [r.x for r in days.select(planner.retriever_days(F.col("t"), F.col("d")).alias("x")).collect()] == [["DAY1"], None, ["DAY2"], ["DAY2"]]


def test_annotations(spark, tmp_path):
    (tmp_path / "nlq.json").write_text('{"version": "1", "videos": [{"video_uid": "v", "clips": [{"clip_uid": "c0", "annotations": [{"language_queries": [{"query": "q0", "video_start_sec": 1, "video_end_sec": 2}, {"query": "q1"}]}]}, {"clip_uid": "c1", "annotations": [{"language_queries": [{"query": "q2"}]}]}]}]}')
    nlq = annotations.load(spark, "NLQ", str(tmp_path / "nlq.json"))
    assert [(r.qid, r.start_sec) for r in annotations.nlq_queries(nlq).orderBy("qid").collect()] == [("v_0_0", 1.0), ("v_0_1", -1.0), ("v_1_0", -1.0)]
    assert annotations.nlq_queries(nlq, strict=True).count() == 1
    assert [r.scene_id for r in annotations.nlq_scenes(nlq).orderBy("scene_id").collect()] == ["scene_0", "scene_1"]
    assert annotations.video_ids(nlq).first()[0] == "v"
    (tmp_path / "cap.json").write_text('[{"id": "a_en", "video": "x/b.mp4", "conversations": [{"from": "human", "value": "?"}, {"from": "gpt", "value": "hi"}]}]')
    assert {r.key: r.text for r in annotations.caption_index(annotations.load(spark, "captions", str(tmp_path / "cap.json"))).collect()} == {"a_en": "hi", "a": "hi", "b": "hi"}
    (tmp_path / "tree/A1_J/DAY1").mkdir(parents=True)
    (tmp_path / "tree/A1_J/DAY1/DAY1_A1_J_11300000.mp4").write_bytes(b"x")
    clip = annotations.clip_files(spark, str(tmp_path / "tree")).first()
    assert (clip.day, clip.person, clip.who, clip.start) == ("DAY1", "A1", "J", 41400.0)
    with pytest.raises(ValueError, match="unknown dataset kind"):
        annotations.load(spark, "none", "x")
    for person, n in (("A1_J", 1), ("A2_K", 2)):
        (tmp_path / f"DayQA_{person}.json").write_text(f'[{{"ID": "{n}", "need_audio": true, "query_time": {{"date": "DAY{n}", "time": "10000000"}}}}]')
    assert {(r.ID, r.person) for r in annotations.qa_files(spark, str(tmp_path)).collect()} == {("1", "A1_J"), ("2", "A2_K")}
    names = [annotations.write_table(spark.range(1), str(tmp_path), "metrics").rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["metrics", "metrics_1", "metrics_2"]
    rows = spark.createDataFrame([("v.mp4", 1)], "video_name string, keyframes int")
    annotations.write_dataset(rows, str(tmp_path / "out"))
    assert annotations.read_dataset(spark, str(tmp_path / "out")).first().asDict() == {"video_name": "v"}


def test_encoder(spark):
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = [r.vec for r in encoders.with_vectors(rows, "t", lambda: encoders.hashing_encoder(8)).collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1.0) and got[1] == got[2] == [0.0] * 8


def test_stream_equals_batch(spark, tmp_path):
    source = views.table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    run = events.segments(stream).writeStream.format("memory").queryName("segments").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("segments").collect())) == sorted(map(tuple, events.segments(source).collect()))
    assert events.first_seen(source, ["user_id"]).count() == source.select("user_id").distinct().count()


def test_late_events_are_left_out(spark, tmp_path):
    """Rows behind the watermark change nothing that a stream has given out."""
    day = "2024-01-01 {}:00"
    parts = [[("00:00", 1.0), ("00:20", 2.0)], [("05:00", 3.0)], [("00:10", 9.0), ("05:01", 4.0)]]
    for n, rows in enumerate(parts):
        df = spark.createDataFrame([(day.format(t), v) for t, v in rows], "t string, value double").select(F.to_timestamp("t").alias("ts"), F.lit(1).alias("user_id"), "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        seen = events.segments(stream, "1 hour", "10 minutes")
        seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.n, r.top) for r in out] == [(2, 2.0)]


def test_numbering_is_by_key(spark):
    from sightline.sources.views import numbered

    rows = [(i, i % 3) for i in range(0, 40000, 7)]
    got = {r.id: r.place for r in numbered(spark.createDataFrame(rows, "id long, k int"), "k", "id", 1000).collect()}
    seen = {}
    for i, k in rows:
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_window_constraints(spark):
    c = F.struct(F.lit("DAY1").alias("query_date"), F.lit(100.0).alias("query_time_sec"), F.array(F.lit("DAY1")).alias("allowed_days"), F.array().cast(planner.RANGES).alias("ranges"), F.lit("before_query_time").alias("relation"))
    ask = lambda day, start: one(spark, filters.in_window(F.lit(day), F.lit(start), F.lit(start + 10), c))
    assert ask("DAY1", 50.0) and not ask("DAY1", 150.0) and not ask("DAY2", 50.0) and ask("", 150.0)


def test_plans_of_a_model(spark):
    raw = F.from_json(F.lit('{"modalities": ["Video", "smell"], "time_of_day": " Late Night "}'), planner.RAW_PLAN.replace("\n", ""))
    base = planner.plan(sentences(spark)).where("qid = 2")
    got = base.select(planner.merged_plan(F.col("plan"), planner.normalised_plan(raw)).alias("p")).first().p
    assert (got.planner, got.modalities, got.allowed_days, got.time_of_day) == ("model", ["video"], [], "late_night")
    assert [tuple(r) for r in got.time_ranges] == [(0.0, 10800.0), (79200.0, 86400.0)] and got.workflow[0] == "day_filter"
    none = F.lit(None).cast(base.schema["plan"].dataType)
    missing = base.select(planner.constraints(none, F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("c"), planner.switches(F.col("plan"), windows=True).alias("s")).first()
    assert missing.c is None and missing.s.use_windows is False
    inferred = base.select(planner.constraints(none, F.lit("yesterday"), F.lit("DAY3"), F.lit(1.0)).alias("c")).first().c
    assert inferred.allowed_days == ["DAY2"] and inferred.relation == "unrestricted"
