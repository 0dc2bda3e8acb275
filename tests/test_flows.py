"""Streams that stop, go on and get late rows; the folder data source."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import intervals
from sightline.sources import clip_tree
from sightline.streaming import events, resume, sessions

SCENES = "video string, scene long, start timestamp, end timestamp, score double"
BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def some_scenes(seed):
    rng, rows = random.Random(seed), []
    for v in (None, "v0", "v1", "v2"):
        t = 0.0
        for k in range(40):
            t += rng.choice([10.0, 10.0, 10.5, 11.0, 12.5, 9.0])
            rows.append((v, k, at(t), at(t + 10), round(rng.random(), 6)))
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, 40)))  # up to 40 s late


def run_once(spark, place, late):
    stream = spark.readStream.schema(SCENES).parquet(f"{place}/in/*")
    made = sessions.capped_sessions(stream, "video", late=late)
    run = made.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def merged(spark, rows):
    table = spark.createDataFrame(rows, SCENES).withColumn("start", F.unix_micros("start") / 1e6).withColumn("end", F.unix_micros("end") / 1e6)
    return sorted((r.video or "", r.scenes, r.n, r.score) for r in intervals.merge_consecutive(table, ["video"]).collect())


def test_sessions_equal_the_batch_over_restarts(spark, tmp_path):
    """Every part is a start of its own from the checkpoint; rows come out of order."""
    sessions.rocksdb(spark)
    rows, parts = some_scenes(1), 3
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], SCENES).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        run_once(spark, tmp_path, "60 seconds")
    early = spark.read.parquet(f"{tmp_path}/out").count()
    spark.createDataFrame([("end", 0, at(1e6), at(1e6), 0.0)], SCENES).coalesce(1).write.parquet(f"{tmp_path}/in/last")
    run_once(spark, tmp_path, "60 seconds")
    got = sorted((r.video or "", r.scenes, r.n, r.score) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == merged(spark, rows) and 0 < early < len(got)
    # A row behind the watermark changes nothing that was given out.
    spark.createDataFrame([("v0", 99, at(20), at(30), 9.0)], SCENES).coalesce(1).write.parquet(f"{tmp_path}/in/late")
    run_once(spark, tmp_path, "60 seconds")
    assert sorted((r.video or "", r.scenes, r.n, r.score) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == got


TABLE = "key long, stamp long, made string"


def encoder(calls, fail=False):
    def encode(rows):
        if fail:
            raise RuntimeError("the encoder died")
        calls.append(sorted((r.key, r.stamp) for r in rows.collect()))
        return rows.select("key", "stamp", F.concat(F.lit("e"), "text").alias("made"))

    return encode


def feed(spark, place, rows):
    spark.createDataFrame(rows, "key long, stamp long, text string").coalesce(1).write.mode("append").parquet(f"{place}/in")


def go(spark, place, table, encode, **more):
    stream = spark.readStream.schema("key long, stamp long, text string").parquet(f"{place}/in")
    run = resume.encode_stream(stream, table, encode, f"{place}/checkpoint", **more).trigger(availableNow=True).start()
    run.awaitTermination()


def held(table, number=None):
    return sorted((r.key, r.stamp, r.made) for r in table.read(number).collect())


def test_resume_skips_and_replaces(spark, tmp_path):
    table, calls = resume.VersionedTable(spark, f"file://{tmp_path}/t", "key", "stamp", TABLE, buckets=4), []
    feed(spark, tmp_path, [(k, 1, f"t{k}") for k in range(12)] + [(3, 0, "old"), (None, 1, "x")])
    go(spark, tmp_path, table, encoder(calls))
    assert held(table) == [(k, 1, f"et{k}") for k in range(12)] and calls[-1] == [(k, 1) for k in range(12)]
    before = table.state()
    feed(spark, tmp_path, [(5, 1, "again"), (6, 2, "new"), (20, 1, "t20")])
    go(spark, tmp_path, table, encoder(calls))
    assert calls[-1] == [(6, 2), (20, 1)]  # what is there is not encoded again
    want = sorted([(k, 1, f"et{k}") for k in range(12) if k != 6] + [(6, 2, "enew"), (20, 1, "et20")])
    assert held(table) == want and held(table, 1) == [(k, 1, f"et{k}") for k in range(12)]
    after = table.state()
    assert any(before["folders"][b] == after["folders"][b] for b in before["folders"])  # untouched buckets keep their files
    table.vacuum()
    assert held(table) == want and table.versions() == [after["version"]]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table, calls = resume.VersionedTable(spark, f"file://{tmp_path}/t", "key", "stamp", TABLE), []
    rows = spark.createDataFrame([(1, 1, "a")], "key long, stamp long, made string")
    assert table.merge(rows, "w", 0) and not table.merge(rows.withColumn("made", F.lit("b")), "w", 0)
    assert held(table) == [(1, 1, "a")] and table.merge(rows.withColumn("made", F.lit("c")), "other", 0)
    assert held(table) == [(1, 1, "c")]


@pytest.mark.parametrize("when", ["encoding", "before the version", "after the version"])
def test_crashes(spark, tmp_path, when, monkeypatch):
    """Whenever a batch is cut off, the next start leads to the same table as without the crash."""
    table, calls = resume.VersionedTable(spark, f"file://{tmp_path}/t", "key", "stamp", TABLE), []
    feed(spark, tmp_path, [(k, 1, f"t{k}") for k in range(6)])
    commit = resume.VersionedTable._commit

    def cut(self, state):
        if when == "after the version":
            commit(self, state)
        raise RuntimeError("the driver died")

    with monkeypatch.context() as patch:
        if when != "encoding":
            patch.setattr(resume.VersionedTable, "_commit", cut)
        with pytest.raises(Exception, match="died"):
            go(spark, tmp_path, table, encoder(calls, fail=when == "encoding"))
    assert held(table) == ([(k, 1, f"et{k}") for k in range(6)] if when == "after the version" else [])
    version = table.state()["version"]
    go(spark, tmp_path, table, encoder(calls))
    assert held(table) == [(k, 1, f"et{k}") for k in range(6)]
    assert table.state()["version"] == max(version, 1)


def test_two_writers(spark, tmp_path):
    table = resume.VersionedTable(spark, f"file://{tmp_path}/t", "key", "stamp", TABLE)
    table.merge(spark.createDataFrame([(1, 1, "a")], TABLE), "one", 0)
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(table.state())


def test_first_seen_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, key long"
    for n, rows in enumerate([[(at(0), 1), (at(5), 2), (at(6), 1)], [(at(50), 2), (at(60), 3)], [(at(4000), 9)], [(at(5000), 1), (at(5001), 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        run = events.first_seen(stream, ["key"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1, 2, 3, 9]  # key 1 was forgotten behind the watermark


# The folder data source

TREE = ["A1_ANNA/DAY1/DAY1_A1_ANNA_11300000.mp4", "A1_ANNA/DAY1/clip.MP4", "A1_ANNA/DAY1/notes.txt", "A1_ANNA/DAY2/DAY2_A1_ANNA_09000050.mp4", "A2_BO_B/DAY1/other_12000000.mp4", "misc/DAY1/x.mp4", "A1_ANNA/extra/y.mp4"]


@pytest.fixture()
def tree(tmp_path):
    for name in TREE:
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write("x" * len(name))
    return str(tmp_path)


def test_tree(spark, tree):
    clip_tree.register(spark)
    rows = clip_tree.named_clips(spark.read.format("clip_tree").load(tree)).collect()
    got = {r.path[len(tree) + 1 :]: (r.person, r.who, r.day, r.start) for r in rows}
    assert got == {
        TREE[0]: ("A1", "ANNA", "DAY1", 41400.0), TREE[1]: ("A1", "ANNA", "DAY1", None),
        TREE[3]: ("A1", "ANNA", "DAY2", 32400.5), TREE[4]: ("A2", "BO_B", "DAY1", 43200.0),
    }
    assert {r.path[len(tree) + 1 :]: r.size for r in rows} == {n: len(n) for n in got}


def test_filters_choose_folders(spark, tree):
    """A filter on the day reads that day's folders only: as many tasks as there are such folders."""
    clip_tree.register(spark)
    every = spark.read.format("clip_tree").load(tree)
    assert every.rdd.getNumPartitions() == 3
    assert every.where("day = 'DAY2'").rdd.getNumPartitions() == 1
    both = every.where("day IN ('DAY1', 'DAY9') AND person = 'A2' AND size > 1")
    assert both.rdd.getNumPartitions() == 1 and [r.person for r in both.collect()] == ["A2"]
    assert every.where("day = 'DAY1' AND day = 'DAY2'").count() == 0
    reader = clip_tree._Reader(clip_tree._Tree.of({"path": tree}))
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("day",), "DAY2"), GreaterThan(("size",), 1)])] == [GreaterThan]
    assert [p.path for p in reader.partitions()] == [f"{tree}/A1_ANNA/DAY2"]


def test_tree_as_a_stream(spark, tree, tmp_path_factory):
    clip_tree.register(spark)
    place = tmp_path_factory.mktemp("stream")

    def go_on():
        stream = spark.readStream.format("clip_tree").load(tree).select("file", "day")
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.file for r in spark.read.parquet(f"{place}/out").collect())

    first = go_on()
    assert len(first) == 4 and go_on() == first
    path = f"{tree}/A2_BO_B/DAY1/new_01000000.mp4"
    with open(path, "w"):
        pass
    os.utime(path, (2e9, 2e9))
    assert go_on() == sorted([*first, "new_01000000.mp4"])


def test_tree_needs_a_path(spark):
    with pytest.raises(ValueError):
        clip_tree._Tree.of({})
