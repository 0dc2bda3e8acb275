"""Updates inside nested annotations; model stages that fail, hang and are shared; searches under plans."""

import copy
import json
import time

import pytest
from pyspark.sql import functions as F

from sightline.sources import annotations, models, nested

ENTRY = {"template": None, "slot_x": None, "verb_x": None, "raw_tags": None, "video_start_sec": 0.0, "video_end_sec": 1.0, "video_start_frame": 0, "video_end_frame": 1, "clip_start_sec": 0.0, "clip_end_sec": 1.0}


def entry(text, start=0.0):
    return {"query": text, **ENTRY, "video_start_sec": start}


def some_file(n):
    clip = lambda c, notes: {"clip_uid": c, "video_start_sec": 0.0, "video_end_sec": 9.0, "video_start_frame": 0, "video_end_frame": 9, "annotations": notes}
    note = lambda *qs: {"language_queries": [entry(q, float(k)) for k, q in enumerate(qs)]}
    return {"version": "1", "split": f"s{n}", "videos": [
        {"video_uid": f"v{n}", "clips": [clip("c0", [note("a", "b", "a"), note("a")]), clip("c1", [note("a"), {"language_queries": []}])]},
        {"video_uid": f"w{n}", "clips": [clip("c0", None)]}, {"video_uid": f"x{n}", "clips": []}, {"video_uid": "shared", "clips": [clip("c0", [note("a", f"only {n}")])]},
    ]}


@pytest.fixture()
def nlq(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.json").write_text(json.dumps(some_file(n)))
    return annotations.read_json(spark, str(tmp_path), annotations.NLQ)


def plain_replaced(data, changes, whole, by_clip):
    data, hits = copy.deepcopy(data), 0
    for v in data["videos"]:
        for c in v["clips"]:
            for a in c["annotations"] or []:
                for k, q in enumerate(a["language_queries"]):
                    new = changes.get((v["video_uid"], c["clip_uid"] if by_clip else "", q["query"]))
                    if new is not None:
                        hits += 1
                        a["language_queries"][k] = new if whole else {**q, "query": new}
    return data, hits


def as_data(files):
    return {r["split"]: {k: v for k, v in r.asDict(True).items() if k != "file"} for r in files.collect()}


def test_whole_entries_by_clip(spark, nlq):
    kind = f"video_uid string, clip_uid string, query string, seq int, new {annotations.QUERY}".replace("\n", "")
    rows = [("v0", "c0", "a", 1, entry("old")), ("v0", "c0", "a", 2, entry("new", 7.0)), ("shared", "c0", "only 1", 1, entry("both")), ("v1", "c9", "a", 1, entry("nowhere")), (None, "c0", "a", 1, entry("x")), ("v1", None, "a", 1, entry("x")), ("v1", "c1", "a", 1, None)]
    done = nested.replaced(nested.videos_of(nlq), spark.createDataFrame(rows, kind), "new")
    want = {("v0", "c0", "a"): entry("new", 7.0), ("shared", "c0", "only 1"): entry("both")}
    plain = [plain_replaced(some_file(n), want, True, True) for n in range(2)]
    assert as_data(nested.files_of(done)) == {f"s{n}": d for n, (d, _) in enumerate(plain)}
    assert done.agg(F.sum("n_queries"), F.sum("n_replaced")).first() == (14, sum(h for _, h in plain))


def test_texts_by_video(spark, nlq):
    rows = [("v0", "a", 1, "A"), ("shared", "a", 3, "S"), ("shared", "a", 2, "no"), ("v1", "b", 1, None)]
    done = nested.replaced(nested.videos_of(nlq), spark.createDataFrame(rows, "video_uid string, query string, seq int, new string"), "new", by_clip=False)
    want = {("v0", "", "a"): "A", ("shared", "", "a"): "S"}
    assert as_data(nested.files_of(done)) == {f"s{n}": plain_replaced(some_file(n), want, False, False)[0] for n in range(2)}


def test_places_stay_for_the_reader(spark, nlq):
    """Query ids, which are places, are the same before and after; the written files read back."""
    rows = [("v0", "a", 1, "A")]
    done = nested.files_of(nested.replaced(nested.videos_of(nlq), spark.createDataFrame(rows, "video_uid string, query string, seq int, new string"), "new", by_clip=False))
    before, after = ({r.qid: r.query_text for r in annotations.nlq_queries(x).where("video_uid <> 'shared'").collect()} for x in (nlq, done))
    assert before.keys() == after.keys() and {q for q in before if before[q] != after[q]} == {"v0_0_0", "v0_0_2", "v0_1_0", "v0_2_0"}


def test_no_changes(spark, nlq):
    none = spark.createDataFrame([], "video_uid string, query string, seq int, new string")
    done = nested.replaced(nested.videos_of(nlq), none, "new", by_clip=False)
    assert as_data(nested.files_of(done)) == {f"s{n}": some_file(n) for n in range(2)} and done.agg(F.sum("n_replaced")).first()[0] == 0


# Models


class Upper:
    """A fake model: counts what it does by files, fails on some texts and hangs on others."""

    def __init__(self, folder):
        import os
        import uuid

        self.folder = folder
        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def __call__(self, rows):
        import time
        import uuid

        with open(f"{self.folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(f"{r['path']}|{r['text']}" for r in rows))
        if any(r["text"] == "fail" for r in rows):
            raise ValueError("bad text")
        if any(r["text"] == "hang" for r in rows):
            time.sleep(30)
        return [None if r["text"] == "none" else {"label": r["text"].upper(), "size": len(r["text"])} for r in rows]


def stage(folder, **more):
    return models.Stage("upper", lambda: Upper(folder), lambda m, rows: m(rows), "label string, size int", version=folder, inputs=("path", "text"), **more)


def rows_of(spark, texts):
    return spark.createDataFrame([(k, f"f{k % 3}", t) for k, t in enumerate(texts)], "id long, path string, text string").repartition(3)


def test_typed_results_and_batches_by_source(spark, tmp_path):
    texts = [f"t{k}" for k in range(30)] + ["none"]
    found = models.with_model(rows_of(spark, texts), stage(str(tmp_path), batch=4), "path", ["id"])
    assert found.schema["result"].dataType.simpleString() == "struct<label:string,size:int>"
    got = {r.id: (r.result and (r.result.label, r.result.size), r.error) for r in found.collect()}
    assert got == {k: ((t.upper(), len(t)) if t != "none" else None, None) for k, t in enumerate(texts)}
    calls = [p.read_text().split("\n") for p in tmp_path.glob("call-*")]
    assert all(len({x.split("|")[0] for x in c}) == 1 and len(c) <= 4 for c in calls)
    loads = list(tmp_path.glob("load-*"))
    assert len(loads) == len({p.name.split("-")[1] for p in loads})  # once a worker


def test_a_model_that_fails_or_hangs(spark, tmp_path):
    texts = ["a", "b", "c", "fail", "hang", "d"]
    start = time.time()
    found = models.with_model(rows_of(spark, texts), stage(str(tmp_path), batch=1, seconds=1.5), "path", ["id"]).collect()
    got = {r.id: (r.result.label if r.result else None, r.error) for r in found}
    assert {k: v for k, (v, _) in got.items()} == {0: "A", 1: "B", 2: "C", 3: None, 4: None, 5: "D"}
    assert got[3][1] == "ValueError: bad text" and got[4][1].startswith("TooSlow") and time.time() - start < 25


def test_fall_back_to_the_heuristic_plan(spark, tmp_path):
    """A planner model whose answer is missing leaves the heuristic plan; one that answers goes over it."""
    from sightline.plans import planner

    asked = spark.createDataFrame([(1, "q1", "what did I say yesterday", "DAY3", 100.0, False), (2, "q2", "fail", "DAY3", 100.0, False)], "qid long, path string, query_text string, query_date string, query_time_sec double, need_audio boolean")

    def plans(model, rows):
        if any(r["query_text"] == "fail" for r in rows):
            raise ValueError("no plan")
        return [{"modalities": ["text"], "allowed_days": ["day 6"], "time_of_day": None, "time_ranges": None, "relation": None, "use_windows": None, "rewrite_query": None, "workflow": None} for _ in rows]

    raw = planner.RAW_PLAN.replace("\n", " ")
    made = models.with_model(asked, models.Stage("planner", lambda: None, plans, raw, inputs=("query_text",)), "path")
    rows = planner.plan(asked).join(made.select("qid", "result", "error"), "qid")
    got = {r.qid: r for r in rows.select("qid", planner.merged_plan(F.col("plan"), planner.normalised_plan(F.col("result"))).alias("p"), "error").collect()}
    assert (got[1].p.planner, got[1].p.allowed_days, got[1].p.modalities, got[1].error) == ("model", ["DAY6"], ["text"], None)
    assert (got[2].p.planner, got[2].p.allowed_days, got[2].error) == ("heuristic", ["DAY3"], "ValueError: no plan")
    either = made.select("qid", models.or_else(F.col("result.modalities"), F.array(F.lit("video"))).alias("m"))
    assert {r.qid: r.m for r in either.collect()} == {1: ["text"], 2: ["video"]}


def test_profiles():
    assert stage("x").profile() is None
    needs = stage("x", cpus=2, gpus=0.5).profile().taskResources
    assert (needs["cpus"].amount, needs["gpu"].amount) == (2.0, 0.5)


def test_empty_input(spark, tmp_path):
    assert models.with_model(spark.createDataFrame([], "id long, path string, text string"), stage(str(tmp_path)), "path").count() == 0


# Searches under plans


def plan_rows(spark, rows):
    kind = "qid long, c struct<query_date:string,query_time_sec:double,allowed_days:array<string>,ranges:array<struct<s:double,e:double>>,relation:string>, s struct<modalities:array<string>,use_windows:boolean,rewrite_query:boolean>, tags array<string>"
    return spark.createDataFrame(rows, kind)


VIDEOS = [("v1", "DAY1", 100.0, ["Cook"]), ("v2", "DAY2", 5000.0, ["walk"]), ("v3", "DAY2", 9000.0, ["cook"]), ("v4", "DAY3", None, None)]


def test_each_constraint_changes_the_videos(spark):
    from sightline.plans import search

    videos = spark.createDataFrame([(v, d, s, t, [("a", [1.0, 0.01 * k])]) for k, (v, d, s, t) in enumerate(VIDEOS)], "video string, day string, start double, tags array<string>, vecs array<struct<modality:string,vec:array<double>>>")
    free = {"query_date": None, "query_time_sec": None, "allowed_days": [], "ranges": [], "relation": "unrestricted"}
    cases = {
        1: (None, [], {"v1", "v2", "v3", "v4"}),
        2: ({**free, "allowed_days": ["DAY2"]}, [], {"v2", "v3"}),
        3: ({**free, "allowed_days": ["DAY9"]}, [], {"v1", "v2", "v3", "v4"}),  # nothing left: the filter is not applied
        4: ({**free, "allowed_days": ["DAY2"], "ranges": [(8000.0, 9999.0)]}, [], {"v3"}),
        5: ({**free, "allowed_days": ["DAY2"], "ranges": [(1.0, 2.0)]}, [], {"v2", "v3"}),
        6: ({**free, "relation": "before_query_time", "query_time_sec": 6000.0}, [], {"v1", "v2", "v4"}),
        7: ({**free, "relation": "after_query_time", "query_time_sec": 6000.0}, [], {"v3", "v4"}),
        8: (None, ["COOK"], {"v1", "v3"}),
        9: ({**free, "allowed_days": ["DAY2"]}, ["cook"], {"v3"}),
        10: (None, ["none has it"], set()),
        11: ({**free, "allowed_days": ["DAY9"], "ranges": [(5000.0, 5001.0)]}, [], {"v2", "v4"}),
    }
    asked = plan_rows(spark, [(q, c, None, t) for q, (c, t, _) in cases.items()]).drop("s").withColumn("vecs", F.expr("array(named_struct('modality', 'a', 'vec', array(1.0D, 0.0D)))"))
    for blocks in ((4096, 4096), (1, 3)):
        got = {}
        for r in search.permitted_videos(videos, asked, 9, *blocks).collect():
            got.setdefault(r.qid, set()).add(r.video)
        assert {q: got.get(q, set()) for q in cases} == {q: want for q, (_, _, want) in cases.items()}
