"""Readers of annotations and clips, updates of annotations, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import clip_parts, clip_start, day_label, day_number, stem, time_seconds
from ..operators.filters import with_target
from .tables import small

QUERY = """struct<query:string,template:string,slot_x:string,verb_x:string,raw_tags:array<string>,video_start_sec:double,video_end_sec:double,
video_start_frame:int,video_end_frame:int,clip_start_sec:double,clip_end_sec:double>"""
NLQ = f"""version string, split string, videos array<struct<video_uid:string,clips:array<struct<clip_uid:string,video_start_sec:double,
video_end_sec:double,video_start_frame:int,video_end_frame:int,annotations:array<struct<language_queries:array<{QUERY}>>>>>>>"""
DAY_QA = """ID string, query_time struct<date:string,time:string>, target_time struct<date:string,time:string>, type string, need_audio boolean,
need_name boolean, last_time boolean, trigger string, question string, choice_a string, choice_b string, choice_c string, choice_d string,
answer string, keywords string, reason string"""
CAPTIONS = "id string, video string, conversations array<struct<`from`:string,value:string>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema.replace("\n", "")).json(path, multiLine=True)


def nlq_queries(nlq: DataFrame, strict: bool = False) -> DataFrame:
    """``qid, video_uid, clip_uid, query_text, start_sec, end_sec, start_frame, end_frame``.

    A qid is video, place of the annotation over all clips of the video, place of the query. Missing times become -1; the
    strict reader drops blank queries and missing times instead.
    """
    videos = nlq.select(F.explode("videos").alias("v"))
    flat = F.flatten(F.transform("v.clips", lambda c: F.transform(F.coalesce(c["annotations"], F.array()), lambda a: F.struct(c["clip_uid"].alias("clip"), a["language_queries"].alias("qs")))))
    notes = videos.select("v.video_uid", F.posexplode(flat).alias("j", "a"))
    rows = notes.select("video_uid", F.col("a.clip").alias("clip_uid"), "j", F.posexplode("a.qs").alias("i", "q"))
    if strict:
        rows = rows.where("trim(coalesce(q.query, '')) <> '' AND q.video_start_sec IS NOT NULL AND q.video_end_sec IS NOT NULL")
    time = lambda c, none: F.coalesce(f"q.{c}", F.lit(none))
    return rows.select(
        F.concat_ws("_", "video_uid", "j", "i").alias("qid"), "video_uid", "clip_uid", F.col("q.query").alias("query_text"),
        time("video_start_sec", -1.0).alias("start_sec"), time("video_end_sec", -1.0).alias("end_sec"),
        time("video_start_frame", -1).alias("start_frame"), time("video_end_frame", -1).alias("end_frame"),
    )


def nlq_scenes(nlq: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """``video_uid, scene_id, start_time, end_time, start_frame, end_frame``, one scene a clip; only of ``videos`` if given."""
    rows = nlq.select(F.explode("videos").alias("v")).select("v.video_uid", F.posexplode("v.clips").alias("pos", "c"))
    rows = rows if videos is None else rows.join(videos, "video_uid", "left_semi")
    zero = lambda c, none: F.coalesce(f"c.{c}", F.lit(none))
    return rows.select(
        "video_uid", F.concat(F.lit("scene_"), F.col("pos").cast("string")).alias("scene_id"), zero("video_start_sec", 0.0).alias("start_time"),
        zero("video_end_sec", 0.0).alias("end_time"), zero("video_start_frame", 0).alias("start_frame"), zero("video_end_frame", 0).alias("end_frame"),
    )


def video_ids(nlq: DataFrame) -> DataFrame:
    return nlq.select(F.explode("videos").alias("v")).select("v.video_uid").where("coalesce(video_uid, '') <> ''")


def day_qa(entries: DataFrame) -> DataFrame:
    """Day-QA entries (DAY_QA) with ``id`` and false for flags that aren't given; fields of other languages are gone."""
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("need_audio", "need_name", "last_time")]
    same = ["type", "trigger", "question", "choice_a", "choice_b", "choice_c", "choice_d", "answer", "keywords", "reason"]
    return entries.select(F.col("ID").alias("id"), "query_time", "target_time", *flags, *same)


def day_queries(annotations: DataFrame, videos: DataFrame, keep_named: bool = False) -> DataFrame:
    """Annotations of :func:`day_qa` beside every video (video) whose name has the query's day, with ``query_sec`` and
    ``target_sec``; without those that need a name, or whose target's time is missing or can't be read."""
    rows = annotations if keep_named else annotations.where(~F.coalesce("need_name", F.lit(False)))
    rows = rows.withColumn("query_sec", time_seconds(F.col("query_time.time"))).withColumn("target_sec", time_seconds(F.col("target_time.time")))
    rows = rows.where(with_target(F.col("target_time.date"), F.col("target_time.time"), F.col("target_sec"))).withColumn("_day", day_number(F.col("query_time.date")))
    return rows.join(small(videos.withColumn("_day", day_number(stem(F.col("video"))))), "_day").drop("_day")


def person_of(name: Column) -> Column:
    """The second part of ``DAYx_An_...``."""
    return F.nullif(F.split_part(stem(name), F.lit("_"), F.lit(2)), F.lit(""))


def qa_files(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all ``*QA_*.json`` files of a folder, with the person that the file's name says."""
    rows = spark.read.schema(DAY_QA.replace("\n", "")).option("multiLine", True).option("pathGlobFilter", "*QA_*.json").json(folder)
    return rows.withColumn("person", F.regexp_extract(stem(F.input_file_name()), r"QA_(.+)$", 1))


def captions_of(clips: DataFrame, index: DataFrame) -> DataFrame:
    """``clips`` (name, path) with ``caption``: by the clip's name, else by its file's, else empty.

    The index is sent to all executors if it is small, by count; both look-ups are shuffles otherwise.
    """
    index = small(index)
    by_name, by_file = (index.select(F.col("key").alias(k), F.col("text").alias(t)) for k, t in (("_n", "_by_name"), ("_f", "_by_file")))
    joined = clips.join(by_name, F.col("name") == F.col("_n"), "left").join(by_file, stem(F.col("path")) == F.col("_f"), "left")
    return joined.withColumn("caption", F.coalesce("_by_name", "_by_file", F.lit(""))).drop("_n", "_f", "_by_name", "_by_file")


def nlq_entry(row: Column) -> Column:
    """A refactored query as an entry of the nested annotations, with the tags as they were given."""
    blank = lambda c: F.coalesce(row[c], F.lit(""))
    own = [row[c].alias(c) for c in ("clip_start_sec", "clip_end_sec", "video_start_sec", "video_end_sec", "video_start_frame", "video_end_frame", "query")]
    optional = [F.nullif(row[c], F.lit("")).alias(c) for c in ("template", "slot_x", "verb_x")]
    return F.struct(*own, *optional, F.array(blank("template"), row["query"], blank("slot_x"), blank("verb_x")).alias("raw_tags"))


def caption_index(captions: DataFrame) -> DataFrame:
    """``key, text``: the first answer of each entry under its id, its id without ``_en`` and its video's name.

    Of entries with the same key the last wins: by file name, then place in the file (files are read whole, in order).
    """
    said = F.filter("conversations", lambda c: (c["from"] == "gpt") & (F.coalesce(c["value"], F.lit("")) != ""))
    rows = captions.withColumn("seq", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")) if "seq" not in captions.columns else F.col("seq"))
    rows = rows.withColumn("text", F.get(said, F.lit(0))["value"]).where("text IS NOT NULL")
    keys = F.array_distinct(F.array_compact(F.array("id", F.regexp_replace("id", "_en$", ""), stem(F.col("video")))))
    return rows.select(F.explode(keys).alias("key"), "text", "seq").groupBy("key").agg(F.max_by("text", "seq").alias("text"))


def clip_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, name, day, person, who, start`` of all mp4 files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", "true").load(root).select("path")
    named = files.withColumn("name", stem(F.col("path")))
    parts = named.withColumn("p", clip_parts(F.col("name")))
    return parts.select("path", "name", day_label(F.col("name")).alias("day"), F.col("p.person").alias("person"), F.col("p.who").alias("who"), clip_start(F.col("name")).alias("start"))


def updated(rows: DataFrame, changes: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """``rows`` with ``value`` replaced where ``changes`` has the keys (the last by ``seq`` wins), and ``replaced``."""
    last = changes.groupBy(*keys).agg(F.max_by(value, seq).alias("_new"))
    joined = rows.join(last, keys, "left")
    return joined.withColumn("replaced", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", value)).drop("_new")


def first_of_each(parts: list[DataFrame], keys: list[str], seq: str) -> DataFrame:
    """The union of the parts (columns may differ) with ``part``; of each key only its first row, by part and then ``seq``."""
    rows = None
    for n, part in enumerate(parts):
        part = part.withColumn("part", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    best = rows.groupBy(*keys).agg(F.min(F.struct("part", seq)).alias("_first"))
    first = rows.join(best, keys).where((F.col("part") == F.col("_first.part")) & (F.col(seq) == F.col(f"_first.{seq}")))
    return first.drop("_first").dropDuplicates(keys)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; quotes inside quoted fields are doubled, as most readers expect, and blanks at the ends of texts stay."""
    own = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("errorifexists").options(**own).csv(path)


def write_table(rows: DataFrame, folder: str, name: str) -> str:
    """Writes a CSV table under a name that is free: ``name``, ``name_1``, ``name_2``; returns the path.

    A name is taken by making an empty file that must not be there yet, so two writers never get the same one.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    files, n = place(folder).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    while True:
        free = f"{name}_{n}" if n else name
        if not files.exists(place(f"{folder}/{free}")) and files.createNewFile(place(f"{folder}/_names/{free}")):
            write_csv(rows, f"{folder}/{free}")
            return f"{folder}/{free}"
        n += 1


def write_dataset(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet without key frames, partitioned by ``by``."""
    rows.drop("keyframes").write.mode("errorifexists").partitionBy(*(by or [])).parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("video_name", F.regexp_replace("video_name", r"\.[^.]*$", "")) if "video_name" in rows.columns else rows


LOADERS = {"nlq": lambda spark, path: read_json(spark, path, NLQ), "day_qa": lambda spark, path: read_json(spark, path, DAY_QA), "captions": lambda spark, path: read_json(spark, path, CAPTIONS), "dataset": read_dataset}


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Reads by a kind's name, case apart."""
    if kind.lower() not in LOADERS:
        raise ValueError(f"unknown dataset kind {kind!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[kind.lower()](spark, path)
