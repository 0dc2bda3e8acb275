"""Queries of annotations, scene payloads, filters, planning with retrieval, and evaluation over the driver's tables.

Inputs that the tables lack (entries, prompts, constraints) are made from their columns, in the same way here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as c
from .catalogue import ASOF, CENTROIDS, MODAL, SCENES, WINDOWS, clips_sql, query
from .functions import frames, texts, times, vectors
from .operators import filters, intervals, metrics, pooling, ranking, scenes, tagging
from .plans import planner, retrieval, search
from .sources import annotations, tables, views
from .sources.views import table

ARRAY = "array<string>"


def text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- annotations

ENTRIES = """qa AS (SELECT event_id AS id, user_id, 'DAY' || (1 + event_id % 7) AS qdate, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'DAY' || (1 + (event_id // 7) % 7) END AS tdate,
  strftime(ts, '%H%M%S') || '00' AS qtime, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'bad' ELSE strftime(ts, '%H%M%S') || '00' END AS ttime,
  hour(ts) * 3600.0::DOUBLE + minute(ts) * 60 + second(ts) AS "at", event_id % 3 = 1 AS need_audio FROM events WHERE event_id % 5 <> 0)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as they come: through JSON and the reader's schema."""
    i = F.col("event_id")
    at = F.concat(F.date_format("ts", "HHmmss"), F.lit("00"))
    raw = F.struct(
        i.cast("string").alias("ID"),
        F.struct(text("DAY", 1 + i % 7).alias("date"), at.alias("time")).alias("query_time"),
        F.struct(F.when(i % 11 == 0, "").otherwise(text("DAY", 1 + F.floor(i / 7) % 7)).alias("date"), F.when(i % 13 == 0, "").when(i % 17 == 0, "bad").otherwise(at).alias("time")).alias("target_time"),
        F.when(i % 3 == 1, True).when(i % 3 == 2, False).alias("need_audio"),
        F.when(i % 5 == 0, True).alias("need_name"),
        F.lit("外").alias("question_chinese"),
    )
    kept = F.from_json(F.to_json(raw), annotations.DAY_QA.replace("\n", ""))
    return annotations.day_qa(table(spark, sf_dir, "events").select(kept.alias("e")).select("e.*"))


@query(f"""WITH {ENTRIES}, videos AS (SELECT DISTINCT 'DAY' || (1 + (day(ts) - 1) % 7) || '_A' || (user_id % 6) || '_N_10000000.mp4' AS video FROM events)
SELECT id, video, split_part(video, '_', 2) AS person, need_audio, "at" AS query_sec, "at" AS target_sec FROM qa JOIN videos ON regexp_extract(video, 'DAY(\\d+)', 1) = regexp_extract(qdate, 'DAY(\\d+)', 1)
WHERE tdate <> '' AND ttime NOT IN ('', 'bad') AND "at" > 0""")
def day_qa_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    videos = e.select(text("DAY", 1 + (F.dayofmonth("ts") - 1) % 7, "_A", F.col("user_id") % 6, "_N_10000000.mp4").alias("video")).distinct()
    rows = annotations.day_queries(_entries(spark, sf_dir), videos)
    return rows.select(F.col("id").cast("long").alias("id"), "video", annotations.person_of(F.col("video")).alias("person"), "need_audio", "query_sec", "target_sec")


@query("""SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN 'Context: ' || role || chr(10) ELSE '' END || 'Question: ' || trim(text) || chr(10) || chr(10) || 'Options:' || chr(10) || '  A. ' || role || chr(10)
|| '  B. ' || conv_id || chr(10) || '  C. ' || chr(10) || '  D. ' || turn || chr(10) || chr(10) || 'Answer with only the letter of the correct option (A, B, C, or D). Do not add any explanation.') AS prompt_md5 FROM conversations""")
def choice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = [F.col("role"), F.col("conv_id").cast("string"), F.lit(None).cast("string"), F.col("turn").cast("string")]
    prompt = texts.choice_prompt(F.when(F.col("turn") % 2 == 0, text(" ", F.col("role"))), F.col("text"), choices)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"))


@query("""SELECT doc_id, m AS modality, CASE WHEN m = 'audio' AND doc_id % 2 = 0 THEN source ELSE lang END AS text FROM documents, (VALUES ('video'), ('audio'), ('text')) AS v(m)""")
def texts_by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map(F.lit("audio"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("video"), F.lit(""))
    kept = F.from_json(F.to_json(texts.by_modality(F.col("lang"), given, planner.MODALITIES)), "map<string,string>")  # there and back
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(kept).alias("modality", "text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN json_object('clip_start_sec', doc_id % 9, 'clip_end_sec', doc_id % 9 + 2, 'video_start_sec', 1, 'video_end_sec', 2, 'video_start_frame', 3, 'video_end_frame', 4, 'query', lang, 'template', source, 'raw_tags', [source, lang, '', ''])
ELSE json_object('clip_start_sec', doc_id % 9, 'clip_end_sec', doc_id % 9 + 2, 'video_start_sec', 1, 'video_end_sec', 2, 'video_start_frame', 3, 'video_end_frame', 4, 'query', lang, 'raw_tags', ['', lang, '', '']) END::VARCHAR AS entry FROM documents""")
def nlq_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    row = F.struct(
        (i % 9).alias("clip_start_sec"), (i % 9 + 2).alias("clip_end_sec"), F.lit(1).alias("video_start_sec"), F.lit(2).alias("video_end_sec"), F.lit(3).alias("video_start_frame"), F.lit(4).alias("video_end_frame"),
        F.col("lang").alias("query"), F.when(i % 2 == 0, F.col("source")).alias("template"), F.lit("").alias("slot_x"), F.lit(None).cast("string").alias("verb_x"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(annotations.nlq_entry(row)).alias("entry"))


@query("""WITH k AS (SELECT 'clip' || event_id AS key, 't' || event_id AS text FROM events WHERE event_id % 7 = 0 UNION ALL SELECT DISTINCT 'file' || (event_id % 50), 'f' || (event_id % 50) FROM events WHERE (event_id % 50) % 3 = 0),
s AS (SELECT event_id, value FROM events WHERE event_id % 4 = 0)
SELECT e.event_id, coalesce(a.text, b.text, '') AS caption, coalesce(s.value, 0) AS score, CASE WHEN e.event_id % 6 = 0 THEN 'own' ELSE '/p/file' || (e.event_id % 50) || '.mp4' END AS path
FROM events e LEFT JOIN k a ON a.key = 'clip' || e.event_id LEFT JOIN k b ON b.key = 'file' || (e.event_id % 50) LEFT JOIN s ON s.event_id = e.event_id""")
def clip_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    by_name = e.where(i % 7 == 0).select(text("clip", i).alias("key"), text("t", i).alias("text"))
    by_file = e.where(i % 50 % 3 == 0).select(text("file", i % 50).alias("key"), text("f", i % 50).alias("text")).distinct()
    clips = e.select("event_id", text("clip", i).alias("name"), text("/p/file", i % 50, ".mp4").alias("path"))
    found = annotations.captions_of(clips, by_name.union(by_file))
    scored = retrieval.with_scores(found, e.where(i % 4 == 0).select("event_id", F.col("value").alias("score")), ["event_id"])
    scene = F.struct(F.when(i % 6 == 0, "own").otherwise("").alias("source_path"), F.lit(0.0).alias("source_start"), F.lit(0.0).alias("source_end"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    return scored.select("event_id", "caption", "score", scenes.source_range(scene, F.col("path"))["path"].alias("path"))


# ---- scenes


@query(f"""WITH {SCENES} SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'clip' || vec_id ELSE video END AS path, CASE WHEN vec_id % 4 = 0 THEN 0.5 ELSE start END::DOUBLE AS start, CASE WHEN vec_id % 8 = 0 THEN 9.5 ELSE "end" END::DOUBLE AS "end",
CASE WHEN vec_id % 3 = 0 THEN 'n' || ord WHEN vec_id % 2 = 0 THEN 'old' ELSE 'c' || ord END AS caption, CASE WHEN vec_id % 3 = 0 OR vec_id % 2 = 0 THEN 2 ELSE 1 END AS n_meta, '' AS transcript FROM scenes""")
def scene_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    none = F.lit(None).cast("double")
    old = F.when(i % 2 == 0, F.create_map(F.lit("place"), F.lit("p"), F.lit("narration"), F.lit("old"))).otherwise(F.create_map(F.lit("place"), F.lit("p")))
    rows = views.scenes(spark, sf_dir).select("vec_id", "video", "start", "end", text("c", F.col("ord")).alias("caption_text"), old.alias("stored_meta"), F.when(i % 3 == 0, F.create_map(F.lit("narration"), text("n", F.col("ord")))).alias("meta"))
    rows = scenes.with_payload(rows.withColumnRenamed("video", "video_name")).withColumn("video", F.col("video_name"))
    scene = F.struct(F.when(i % 4 == 0, text("clip", i)).alias("source_path"), F.when(i % 4 == 0, 0.5).otherwise(none).alias("source_start"), F.when(i % 8 == 0, 9.5).otherwise(none).alias("source_end"), "start", "end")
    rows = rows.withColumn("source", scenes.source_range(scene, F.col("video")))
    moved = scenes.at_times(F.struct("vec_id", "start", "end"), F.col("source.start"), F.col("source.end"))
    return rows.select("vec_id", F.col("source.path").alias("path"), moved["start"].alias("start"), moved["end"].alias("end"), scenes.narrated(F.col("caption_text"), F.col("meta")).alias("caption"), F.size("meta").cast("long").alias("n_meta"), "transcript")


@query("""WITH e AS (SELECT conv_id, role || turn AS label, (turn + 1) / 10.0::DOUBLE AS confidence, role FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, label) AS rank FROM e
), g AS (SELECT conv_id, string_agg(printf('%s (%.2f)', label, confidence), ', ' ORDER BY rank) FILTER (rank <= 3) AS heard, array_to_string(list_sort(list_distinct(list(role))), ', ') AS who FROM r GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter([CASE WHEN conv_id % 3 <> 0 THEN 'Visual description: cap' || conv_id END, CASE WHEN conv_id % 2 = 0 THEN 'Dialogue/Speech: s' || conv_id END, 'Audio events: ' || heard, 'Speakers detected: ' || who], lambda x: x IS NOT NULL), chr(10)) AS context FROM g""")
def scene_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id")
    said = table(spark, sf_dir, "conversations").select("conv_id", F.concat("role", F.col("turn").cast("string")).alias("label"), ((F.col("turn") + 1) / 10.0).alias("confidence"), "role")
    best = ranking.top_k(said, ["conv_id"], [F.desc("confidence"), F.asc("label")], 5)
    events = best.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "confidence"))), lambda e: F.struct(e["label"], e["confidence"])).alias("events"))
    rows = said.groupBy("conv_id").agg(F.collect_set("role").alias("speakers")).join(events, "conv_id")
    context = texts.scene_context(F.when(i % 3 != 0, text("cap", i)), F.when(i % 2 == 0, text("s", i)).otherwise(""), F.col("events"), F.col("speakers"))
    return rows.select("conv_id", context.alias("context"))


@query(f"""WITH {SCENES} SELECT video, bool_and(vec_id % 3 <> 0 AND video <> 'v1') AS need_audio, video <> 'v2' AND bool_and(b IS NULL) AS need_text, count(*) FILTER (vec_id % 5 = 0 OR vec_id % 7 = 0) AS n_generate FROM scenes GROUP BY video""")
def encoding_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    videos = s.select("video").distinct().select("video", F.when(F.col("video") == "v1", 1).alias("audio"), F.when(F.col("video") == "v2", F.array(F.lit(1.0))).alias("text"))
    rows = s.select("video", "vec_id", F.when(F.col("vec_id") % 3 == 0, 1).alias("audio"), F.col("b").alias("text"))
    step = scenes.text_step(F.when(F.col("vec_id") % 5 == 0, "").otherwise("raw"), F.when(F.col("vec_id") % 7 == 0, "new caption"), F.lit(""))
    steps = s.groupBy("video").agg(F.count_if(step == "generate").alias("n_generate"))
    return scenes.stages_needed(videos, rows, ["audio", "text"]).join(steps, "video")


@query(f"""WITH {SCENES}, {WINDOWS}, t AS (SELECT video, ord, 's' || ord AS text FROM scenes WHERE vec_id % 3 <> 0), m AS (SELECT w.video, w."window", t.text, row_number() OVER (PARTITION BY w.video, w."window" ORDER BY t.ord) AS n FROM windows w JOIN t ON t.video = w.video AND t.ord >= w.first AND t.ord < w.first + w.n_scenes
), x AS (SELECT video, "window", string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM m WHERE n <= 2 GROUP BY ALL), allx AS (SELECT w.video, w."window", coalesce(x.text, '') AS text FROM windows w LEFT JOIN x ON x.video = w.video AND x."window" = w."window"
), v AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY "window") AS n FROM allx WHERE text <> '')
SELECT video, 'window' AS level, "window" AS place, text FROM allx UNION ALL SELECT video, 'video', 0, string_agg(text, chr(10) || chr(10) ORDER BY n) FROM v WHERE n <= 5 GROUP BY video""")
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    rows = s.select("video", "ord", F.when(F.col("vec_id") % 3 == 0, " ").otherwise(text("s", F.col("ord"))).alias("text"))
    inside = intervals.window_members(intervals.scene_windows(s), rows).groupBy("video", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("all"))
    windows = inside.select("video", F.col("window").cast("long").alias("place"), texts.joined_texts(F.col("all"), 2).alias("text"))
    first = ranking.top_k(windows.where("text <> ''"), ["video"], [F.asc("place")], 5)
    whole = first.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("all"))
    return windows.select("video", F.lit("window").alias("level"), "place", "text").union(whole.select("video", F.lit("video"), F.lit(0).cast("long"), texts.joined_texts(F.col("all"), 5)))


@query(f"""WITH {SCENES} SELECT video, CASE WHEN video < 'v5' THEN vec[1] ELSE -1 END::DOUBLE AS x, video < 'v5' AS promoted FROM scenes WHERE ord = 0""")
def promoted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    videos = s.select("video").distinct().withColumn("vec", F.when(F.col("video") >= "v5", F.array(F.lit(-1.0))))
    return scenes.promoted(videos, s, "video", ["vec"]).select("video", F.col("vec")[0].alias("x"), (F.col("video") < "v5").alias("promoted"))


@query(f"""WITH {SCENES}, u AS (SELECT video, list_transform(vec, lambda x: x / greatest(sqrt(list_inner_product(vec, vec)), 1e-8)) AS vec FROM scenes), m AS ({c.mean_sql("u", "video")})
SELECT video, unnest(range(0, len(vec))) AS place, round(unnest(list_transform(vec, lambda x: x / greatest(sqrt(list_inner_product(vec, vec)), 1e-8))), 6) AS x FROM m""")
def prototype_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scenes.prototypes(views.scenes(spark, sf_dir).select("video", "vec"), ["video"])
    return made.select("video", F.posexplode("vec").alias("place", "x")).select("video", F.col("place").cast("long"), F.round("x", 6).alias("x"))


@query(f"""WITH {MODAL}, m AS ({c.mean_sql("modal", "video, modality")}) SELECT 'global' AS level, modality, count(*) AS n, sum(len(vec))::BIGINT AS size FROM m GROUP BY modality UNION ALL SELECT 'scene', modality, count(*), sum(len(vec))::BIGINT FROM modal GROUP BY modality""")
def vectors_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.modal(views.scenes(spark, sf_dir))
    all_ = pooling.mean_vectors(long, ["video", "modality"]).select(F.lit("global").alias("level"), "modality", "vec").union(long.select(F.lit("scene"), "modality", "vec"))
    return all_.groupBy("level", "modality").agg(F.count("*").alias("n"), F.sum(F.size("vec")).alias("size"))


@query()
def shared_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modalities by their own principal components, cut and padded to one size."""
    placed = pooling.shared_space(views.modal(views.scenes(spark, sf_dir)), ["vec_id"], 40)
    return placed.groupBy("modality").agg(F.count("*").alias("n"), F.round(F.avg(vectors.norm(F.col("vec"))), 6).alias("mean_norm"))


@query(f"WITH {SCENES} SELECT video, count(*) AS n, count(b) AS n_left FROM scenes GROUP BY video")
def keyframe_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scenes(spark, sf_dir).withColumnRenamed("b", "keyframes").groupBy("video").agg(F.count("*").alias("n"), F.count("keyframes").alias("n_left"))


@query(f"WITH {SCENES}, n AS (SELECT sqrt(list_inner_product(vec, vec)) AS n FROM scenes) SELECT count(*) AS n, round(min(n), 6) AS least, round(max(n), 6) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM n")
def norm_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.scenes(spark, sf_dir).select(vectors.norm(F.col("vec")).alias("n"))
    return n.agg(F.count("*").alias("n"), *(F.round(f("n"), 6).alias(k) for k, f in (("least", F.min), ("most", F.max), ("mean", F.avg), ("std", F.stddev_pop))))


@query(f"WITH {MODAL} SELECT vec_id FROM modal GROUP BY vec_id HAVING count(DISTINCT modality) = 2")
def in_all_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.modal(views.scenes(spark, sf_dir)).groupBy("vec_id").agg(F.countDistinct("modality").alias("n")).where("n = 2").select("vec_id")


# ---- filters

ASKED = """asked AS (SELECT event_id AS qid, 'v' || (event_id % 10) AS video, CASE WHEN event_id % 100 <> 0 THEN 'DAY' || (1 + (event_id // 20) % 7) END AS qdate, (event_id // 20 % 40) * 20.0::DOUBLE AS qt,
  CASE WHEN (event_id // 20) % 4 = 0 THEN []::VARCHAR[] ELSE ['DAY' || (1 + (event_id // 20) % 7), 'DAY' || (1 + event_id % 3)] END AS days, CASE WHEN (event_id // 20) % 3 = 0 THEN -1 ELSE (event_id // 20 % 30) * 10 END AS s,
  ['before_query_time', 'after_query_time', 'unrestricted'][1 + (event_id // 20) % 3] AS relation, CASE WHEN (event_id // 20) % 5 = 0 THEN []::VARCHAR[] ELSE ['t' || (event_id // 20 % 7)] END AS wanted FROM events WHERE event_id % 20 = 0)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    k = F.floor(i / 20)
    at = k % 30 * 10.0
    made = F.struct(
        F.when(i % 100 != 0, text("DAY", 1 + k % 7)).alias("query_date"),
        (k % 40 * 20.0).alias("query_time_sec"),
        F.when(k % 4 == 0, F.array().cast(ARRAY)).otherwise(F.array(text("DAY", 1 + k % 7), text("DAY", 1 + i % 3))).alias("allowed_days"),
        F.when(k % 3 == 0, F.array().cast(planner.RANGES)).otherwise(F.array(F.struct(at.alias("s"), (at + 400).alias("e")))).alias("ranges"),
        F.element_at(F.array(*map(F.lit, ("before_query_time", "after_query_time", "unrestricted"))), (k % 3 + 1).cast("int")).alias("relation"),
    )
    wanted = F.when(k % 5 == 0, F.array().cast(ARRAY)).otherwise(F.array(text("T", k % 7)))
    return table(spark, sf_dir, "events").where(i % 20 == 0).select(i.alias("qid"), text("v", i % 10).alias("video"), made.alias("c"), wanted.alias("wanted"))


@query(f"""WITH {SCENES}, {WINDOWS}, {ASKED}, w AS (SELECT w.video, w."window", min(s.start) AS start, max(s."end") AS "end", flatten(list(s.tags)) AS tags, CASE WHEN w.video <> 'v0' THEN 'DAY' || (1 + substr(w.video, 2)::INT % 7) ELSE '' END AS day
  FROM windows w JOIN scenes s ON s.video = w.video AND s.ord >= w.first AND s.ord < w.first + w.n_scenes GROUP BY ALL)
SELECT qid, video, "window" FROM asked JOIN w USING (video) WHERE (len(days) = 0 OR day = '' OR list_contains(days, day)) AND (s < 0 OR ("end" >= s AND start <= s + 400)) AND (len(wanted) = 0 OR list_has_any(tags, wanted))
AND (day = '' OR qt <= 0 OR day IS DISTINCT FROM qdate OR ((relation <> 'before_query_time' OR start <= qt) AND (relation <> 'after_query_time' OR "end" >= qt)))""")
def window_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    members = intervals.window_members(intervals.scene_windows(s), s)
    windows = pooling.time_bounds(members, ["video", "window"]).join(pooling.tag_union(members, ["video", "window"]), ["video", "window"])
    day = F.when(F.col("video") != "v0", text("DAY", 1 + F.substring("video", 2, 9).cast("int") % 7)).otherwise("")
    found = filters.windows_met(windows.withColumn("day", day), _asked(spark, sf_dir))
    return found.select("qid", "video", F.col("window").cast("long"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -1.0 ELSE value END::DOUBLE AS s, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN -2.0 ELSE value + 5 END::DOUBLE AS e FROM events
), r AS (SELECT *, CASE WHEN s IS NULL OR s < 0 THEN 0 ELSE s END AS a FROM s), t AS (SELECT *, CASE WHEN e IS NULL OR e < 0 THEN a ELSE e END AS b FROM r)
SELECT event_id, a AS start, b AS "end", coalesce(s >= 0 AND e >= 0, false) AS valid, b > a AS usable, round(CASE WHEN e IS NULL THEN s - 0.5 ELSE s END, 6) AS w_start, round(coalesce(e, s + 0.5), 6) AS w_end FROM t""")
def repaired_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("event_id"), F.lit(None).cast("double")
    s = F.when(i % 5 == 0, none).when(i % 5 == 1, -1.0).otherwise(F.col("value"))
    e = F.when(i % 3 == 0, none).when(i % 3 == 1, -2.0).otherwise(F.col("value") + 5)
    rows = table(spark, sf_dir, "events").select("event_id", metrics.repaired_truth(s, e).alias("t"), metrics.truth_window(s, e).alias("w"))
    return rows.select("event_id", "t.start", "t.end", "t.valid", (F.col("t.end") > F.col("t.start")).alias("usable"), F.round("w.start", 6).alias("w_start"), F.round("w.end", 6).alias("w_end"))


@query("""WITH f AS (SELECT user_id, event_id, value * 5 AS sharpness, value AS brightness FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sharpness DESC, event_id) AS rank FROM f
WHERE sharpness > 100 AND brightness > 20 AND brightness < 235 QUALIFY rank <= 5""")
def sharp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * 5).alias("sharpness"), F.col("value").alias("brightness"))
    good = rows.where(filters.sharp_enough(F.col("sharpness"), F.col("brightness")))
    return ranking.top_k(good, ["user_id"], [F.desc("sharpness"), F.asc("event_id")], 5).select("user_id", "event_id", F.col("rank").cast("long"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang IN ('en', 'de') ORDER BY doc_id LIMIT 50 OFFSET 10)")
def entry_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sliced(table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de")).select("doc_id"), ["doc_id"], 10, 60)


@query(f"""WITH {clips_sql("clips", "view")} SELECT person, day, event_id, row_number() OVER (PARTITION BY person, day ORDER BY value DESC, event_id) AS rank FROM clips QUALIFY rank <= 4""")
def top_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_k(views.clips(spark, sf_dir), ["person", "day"], [F.desc("value"), F.asc("event_id")], 4)
    return best.select("person", "day", "event_id", F.col("rank").cast("long"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents")
def round_robin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("all"))
    return views.numbered(rows, "all", "doc_id").select("doc_id", (F.col("place") % 4).cast("long").alias("shard"))


@query(f"""WITH {SCENES}, m AS (SELECT vec_id, len(list_intersect(tags, ['t1', 't2', 't3', 't9'])) AS n FROM scenes) SELECT vec_id, n, n / 4 AS share, round(0.5::DOUBLE * (1 + 0.1::DOUBLE * n), 6) AS score FROM m""")
def tag_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagging.tag_matches(F.col("tags"), F.array(*map(F.lit, ("t1", "t2", "t3", "t9"))), F.lit(0.5))
    return views.scenes(spark, sf_dir).select("vec_id", found.alias("m")).select("vec_id", "m.n", "m.share", F.round("m.score", 6).alias("score"))


# ---- scalars

RANGE_SQL = "[{'s': (event_id % 30)::DOUBLE, 'e': (event_id % 50)::DOUBLE}, {'s': 60.0::DOUBLE, 'e': 120.0::DOUBLE}, {'s': (event_id * 7 % 3000)::DOUBLE, 'e': (event_id * 11 % 5000)::DOUBLE}]"


@query(f"""WITH d AS (SELECT event_id, list_transform(list_filter(['day 3', 'DAY' || (event_id % 9), 'x', 'Day 03', NULL], lambda x: regexp_matches(x, '(?i)day\\s*\\d+')), lambda x: 'DAY' || regexp_extract(x, '(?i)day\\s*(\\d+)', 1)::INT) AS days, {RANGE_SQL} AS r FROM events
), u AS (SELECT event_id, days, list_transform(list_filter(r, lambda x: x.e > x.s), lambda x: {{'s': x.s, 'e': x.e, 'u': CASE WHEN greatest(abs(x.s), abs(x.e)) < 24 THEN 3600 WHEN greatest(abs(x.s), abs(x.e)) < 1440 THEN 60 ELSE 1 END}}) AS r FROM d
), k AS (SELECT event_id, days, list_filter(list_transform(r, lambda x: {{'s': greatest(0, x.s * x.u), 'e': least(86400, x.e * x.u)}}), lambda x: x.e > x.s) AS r FROM u)
SELECT event_id, array_to_string(list_sort(list_distinct(days)), ',') AS days, array_to_string(list_transform(r, lambda x: x.s::BIGINT || '-' || x.e::BIGINT), ',') AS ranges FROM k""")
def day_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    days = planner.normalised_days(F.array(F.lit("day 3"), text("DAY", i % 9), F.lit("x"), F.lit("Day 03"), F.lit(None)))
    given = [(i % 30, i % 50), (F.lit(60), F.lit(120)), (i * 7 % 3000, i * 11 % 5000)]
    ranges = times.scaled_ranges(F.array(*(F.struct(s.cast("double").alias("s"), e.cast("double").alias("e")) for s, e in given)))
    shown = F.transform(ranges, lambda r: F.concat_ws("-", r["s"].cast("long").cast("string"), r["e"].cast("long").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(days), ",").alias("days"), F.array_join(shown, ",").alias("ranges"))


@query("""WITH v AS (SELECT event_id, value, event_id % 3000 AS total, greatest(0, round_even(value * 10, 0)) AS a, least(round_even((value + 20) * 10, 0), 1500) AS b FROM events)
SELECT event_id, least(512, greatest(128, 4 * floor(value / 4)))::BIGINT AS n_frames, round(CASE WHEN total <= greatest(1, least(total, 992)) THEN 1.0 ELSE greatest(0.1, 30.0 / (total / greatest(1, least(total, 992)))) END::DOUBLE, 6) AS fps,
array_to_string(list_transform(range(4), lambda i: trunc(a + (b - a) / 4.0 / 2 + round_even((b - a) / 4.0 * i, 0))::BIGINT), ',') AS indices, greatest(1, floor(value / 30.0 / 1.5))::BIGINT * 2 AS drawn, least(total // 8 + 1, 6)::BIGINT AS k FROM v""")
def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, total = F.col("value"), F.col("event_id") % 3000
    indices = frames.centred_indices(value, value + 20, F.lit(10.0), F.lit(1500), 0, 4)
    return table(spark, sf_dir, "events").select(
        "event_id",
        frames.frames_by_duration(value).cast("long").alias("n_frames"),
        F.round(frames.adaptive_fps(total, F.lit(30.0)), 6).alias("fps"),
        F.array_join(indices.cast(ARRAY), ",").alias("indices"),
        frames.segment_frames(F.lit(0.0), value, F.lit(30.0)).cast("long").alias("drawn"),
        frames.clusters(total, 6).cast("long").alias("k"),
    )


# ---- tags


@query(f"""WITH {CENTROIDS}, l AS (SELECT item, greatest(quantile_cont(score::DOUBLE, 0.7), 0.1) AS lim FROM sims WHERE item % 20 = 0 GROUP BY item), t AS (SELECT item, tag, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, tag) AS rank FROM sims JOIN l USING (item) WHERE score > lim QUALIFY rank <= 10
), g AS (SELECT item, string_agg(tag, ',' ORDER BY rank) AS tags, count(*) AS n FROM t GROUP BY item)
SELECT vec_id AS qid, CASE WHEN vec_id % 60 = 0 THEN '' ELSE coalesce(g.tags, '') END AS tags, CASE WHEN vec_id % 60 = 0 THEN 0 ELSE coalesce(g.n, 0) END AS n FROM scenes LEFT JOIN g ON g.item = vec_id WHERE vec_id % 20 = 0""")
def query_tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.scenes(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.when(F.col("vec_id") % 60 == 0, " ").otherwise("video text").alias("query_text"))
    scores = c._similarities(spark, sf_dir).where("item % 20 = 0").select(F.col("item").alias("qid"), "tag", "score")
    return tagging.query_tags(q, scores).select("qid", F.array_join("tags", ",").alias("tags"), F.size("scores").cast("long").alias("n"))


def _level_sql(level: str, keys: str, name: str) -> str:
    return f"""e_{level} AS (SELECT {keys}, tag, 0.8::DOUBLE * max(score) + 0.2::DOUBLE * avg(score) AS score FROM f GROUP BY ALL), l_{level} AS (SELECT {keys}, greatest(quantile_cont(score, 0.75), 0.1) AS lim FROM e_{level} GROUP BY ALL),
p_{level} AS (SELECT {keys}, tag, avg((score > 0.8::DOUBLE * lim)::INT) AS share FROM f JOIN l_{level} USING ({keys}) GROUP BY ALL),
o_{level} AS (SELECT '{level}' AS level, {name} AS name, tag, round(score, 6) AS score FROM e_{level} JOIN l_{level} USING ({keys}) JOIN p_{level} USING ({keys}, tag) WHERE score > lim AND share >= 0.05)"""


@query(f"""WITH {CENTROIDS}, f AS (SELECT s.video, s.ord // 3 AS part, s.ord, c.tag, c.score FROM sims c JOIN scenes s ON s.vec_id = c.item), {_level_sql("global", "video", "video")}, {_level_sql("window", "video, part", "video || '/' || part")},
{_level_sql("scene", "video, ord", "video || '/' || ord")} SELECT * FROM o_global UNION ALL SELECT * FROM o_window UNION ALL SELECT * FROM o_scene""")
def tags_of_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir).select(F.col("vec_id").alias("item"), "ord", F.floor(F.col("ord") / 3).alias("part"))
    rows = c._similarities(spark, sf_dir).join(s, "item")
    found = tagging.tag_levels(rows, {"global": ["video"], "window": ["video", "part"], "scene": ["video", "ord"]})
    return found.select("level", "name", "tag", F.round("score", 6).alias("score"))


VOCABULARY = ["the", "and", "to", "on", "is", "of", "in", "at", "for", "are", "they", "and on"]


@query(f"""WITH q AS (
  SELECT conv_id * 1000 + turn AS qid, CASE WHEN turn % 2 = 0 THEN array_to_string(string_split(coalesce(text, ''), ' ')[1:8], ' ') ELSE coalesce(text, '') END AS t FROM conversations
), w AS (SELECT qid, t, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS words FROM q
), s AS (SELECT qid, t, tag, len(list_filter(words, lambda x: x = tag)) / greatest(len(words), 1)::DOUBLE AS score FROM w, unnest({VOCABULARY!r}) AS v(tag)
), l AS (SELECT qid, greatest(quantile_cont(score, 0.7), 0.1) AS lim FROM s GROUP BY qid), r AS (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tag) AS rank FROM s JOIN l USING (qid) WHERE score > lim QUALIFY rank <= 10
), g AS (SELECT qid, string_agg(tag, ',' ORDER BY rank) AS tags FROM r GROUP BY qid)
SELECT qid, CASE WHEN trim(t) = '' THEN '' ELSE coalesce(tags, '') END AS tags FROM q LEFT JOIN g USING (qid)""")
def query_tags_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by the share of a text's words, read from a query's video modality where it has one (even turns), else from its text."""
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("turn"), F.coalesce("text", F.lit("")).alias("text"))
    video = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    decomposed = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("video"), video, F.lit("text"), F.col("text")))
    q = t.select("qid", texts.tagging_text(decomposed, F.col("text")).alias("query_text"))
    words = F.filter(F.split(F.lower("query_text"), " "), lambda x: x != "")
    share = lambda tag: F.size(F.filter("words", lambda x: x == tag)) / F.greatest(F.size("words"), F.lit(1))
    scores = q.withColumn("words", words).select("qid", F.inline(F.array(*(F.struct(F.lit(tag).alias("tag"), share(F.lit(tag)).alias("score")) for tag in VOCABULARY))))
    return tagging.query_tags(q, scores).select("qid", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {SCENES}, {WINDOWS}, t AS (SELECT *, CASE WHEN vec_id % 3 = 0 AND video <> 'v3' THEN 'scene ' || vec_id ELSE '' END AS said, CASE WHEN video <> 'v4' OR vec_id % 3 = 0 THEN vec END AS tvec FROM scenes
), m AS (SELECT w.video, w."window", t.* EXCLUDE (video) FROM windows AS w JOIN t ON t.video = w.video AND t.ord >= w.first AND t.ord < w.first + w.n_scenes
), g AS (SELECT video, "window", string_agg(said, chr(10) ORDER BY ord) FILTER (said <> '') AS texts, count(tvec) AS n, round(avg(tvec[1]), 6) AS first FROM m GROUP BY ALL)
SELECT video, "window", CASE WHEN texts IS NOT NULL THEN texts WHEN n > 0 THEN '{scenes.POOLED}' ELSE '' END AS text, CASE WHEN texts IS NULL AND n > 0 THEN first END AS first FROM g""")
def window_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scenes(spark, sf_dir)
    said = F.when((F.col("vec_id") % 3 == 0) & (F.col("video") != "v3"), text("scene ", F.col("vec_id"))).otherwise("")
    held = rows.select("video", "ord", said.alias("text_raw"), F.when((F.col("video") != "v4") | (F.col("vec_id") % 3 == 0), F.col("vec")).alias("vec"))
    windows = intervals.scene_windows(rows)
    places = windows.withColumn("ord", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_scenes") - 1))).select("video", "window", "ord")
    return scenes.window_texts(places, held).select("video", "window", "text", F.round(F.col("vec")[0], 6).alias("first"))


@query(f"WITH {SCENES}, t AS (SELECT vec_id, unnest(tags) AS tag FROM scenes) SELECT vec_id, count(*) AS n, count(DISTINCT tag) AS n_different FROM t GROUP BY vec_id")
def tags_per_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scenes(spark, sf_dir).select("vec_id", F.size("tags").cast("long").alias("n"), F.size(F.array_distinct("tags")).cast("long").alias("n_different"))


# ---- planning with retrieval

PLANNED = """SELECT vec_id AS qid, lower('Q') || {ends} AS t, CASE WHEN vec_id % 100 <> 0 THEN 'DAY' || (1 + vec_id % 7) END AS d, ((vec_id * 977) % 86400)::DOUBLE AS s, vec_id % 3 = 0 AS need FROM embeddings WHERE vec_id % 20 = 0"""
ENDS_SQL = "CASE (vec_id // 20) % 12 " + " ".join(f"WHEN {n} THEN '{e}'" for n, e in enumerate(c.ENDS)) + " END"


@query(f"""WITH plans AS ({c.planner_sql(PLANNED.format(ends=ENDS_SQL))}), p AS (
  SELECT qid, CASE WHEN qid % 60 = 0 THEN ['DAY2', 'DAY3'] WHEN days = '' THEN []::VARCHAR[] ELSE string_split(days, ',') END AS days, CASE WHEN qid % 60 = 0 THEN 'text,video,audio' ELSE modalities END AS modalities,
         CASE WHEN qid % 60 = 0 THEN 'unrestricted' ELSE relation END AS relation, CASE WHEN qid % 60 = 0 THEN '18000-43200' ELSE ranges END AS ranges FROM plans
), {MODAL.removeprefix("WITH ").strip()}, means AS ({c.mean_sql("modal", "video, modality")}), sc AS (SELECT qid, video, modality, {c.cos_sql("vec", "q_vec")} AS score, len(days) = 0 OR list_contains(days, 'DAY' || (1 + substr(video, 2)::INT % 7)) AS ok, relation, modalities, ranges FROM means JOIN qs USING (modality) JOIN p USING (qid)
), kept AS (SELECT * FROM sc QUALIFY ok OR count(*) FILTER (ok) OVER (PARTITION BY qid) = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid, modality ORDER BY score DESC, video) AS rank FROM kept QUALIFY rank <= 3
), f AS (SELECT qid, video, relation, modalities, ranges, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r GROUP BY ALL)
SELECT qid, video, score, relation, modalities, ranges, row_number() OVER (PARTITION BY qid ORDER BY score DESC, video) AS rank FROM f QUALIFY rank <= 3""")
def plan_then_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic plans, a model's plan over some of them, constraints from both, and videos searched under those."""
    i = F.col("qid")
    long = views.modal(views.scenes(spark, sf_dir))
    vectors_ = views.queries_of(long).drop("video", "ord")
    asked = vectors_.select("qid").distinct().select("qid", F.concat(F.lit("Q"), F.element_at(F.array(*map(F.lit, c.ENDS)), (F.floor(i / 20) % 12 + 1).cast("int"))).alias("query_text"), F.when(i % 100 != 0, text("DAY", 1 + i % 7)).alias("query_date"), ((i * 977) % 86400).cast("double").alias("query_time_sec"), (i % 3 == 0).alias("need_audio"))
    raw = F.from_json(F.when(i % 60 == 0, F.lit('{"modalities": ["Text ", "video", "x", "text"], "allowed_days": ["day 2", "DAY3", "no day"], "relation": " Unrestricted", "time_of_day": "Morning", "use_windows": true}')), planner.RAW_PLAN.replace("\n", ""))
    plans = planner.plan(asked).join(asked, "qid").withColumn("plan", planner.merged_plan(F.col("plan"), planner.normalised_plan(raw)))
    plans = plans.select("qid", planner.constraints(F.col("plan"), F.col("query_text"), F.col("query_date"), F.col("query_time_sec")).alias("c"), planner.switches(F.col("plan")).alias("s"))
    videos = retrieval.with_norm(pooling.mean_vectors(long, ["video", "modality"])).withColumn("day", text("DAY", 1 + F.substring("video", 2, 9).cast("int") % 7))
    best = retrieval.planned_videos(videos, vectors_, plans, 3)
    ranges = F.array_join(F.transform("c.ranges", lambda r: F.concat_ws("-", r["s"].cast("long").cast("string"), r["e"].cast("long").cast("string"))), ";")
    return best.join(plans, "qid").select("qid", "video", "score", "c.relation", F.array_join("s.modalities", ",").alias("modalities"), ranges.alias("ranges"), F.col("video_rank").cast("long").alias("rank"))


TAGGED = "CASE WHEN qid % 40 = 0 THEN ['t1', 't2'] ELSE []::VARCHAR[] END"


@query(f"""WITH plans AS ({c.planner_sql(PLANNED.format(ends=ENDS_SQL))}), asked AS ({PLANNED.format(ends=ENDS_SQL)}), p AS (
  SELECT qid, qid % 60 = 0 AS win, {TAGGED} AS wanted, asked.d AS date, asked.s AS "at",
         CASE WHEN qid % 60 = 0 THEN ['DAY2', 'DAY3'] WHEN days = '' THEN []::VARCHAR[] ELSE string_split(days, ',') END AS days, CASE WHEN qid % 60 = 0 THEN 'unrestricted' ELSE relation END AS relation,
         list_transform(string_split(CASE WHEN qid % 60 = 0 THEN '18000-43200' ELSE nullif(ranges, '') END, ';'), lambda x: [split_part(x, '-', 1)::DOUBLE, split_part(x, '-', 2)::DOUBLE]) AS rng
  FROM plans JOIN asked USING (qid)
), {MODAL}, v AS (SELECT DISTINCT video, 'DAY' || (1 + substr(video, 2)::INT % 7) AS day, CASE WHEN video <> 'v9' THEN substr(video, 2)::INT * 8640.0::DOUBLE END AS start, ['T' || (substr(video, 2)::INT % 3)] AS tags FROM scenes
), pairs AS (
  SELECT qid, video, len(days) = 0 OR list_contains(days, day) AS dated,
         start IS NULL OR ((rng IS NULL OR len(list_filter(rng, lambda x: start + 30 >= x[1] AND start <= x[2])) > 0) AND NOT (relation = 'before_query_time' AND "at" > 0 AND start > "at") AND NOT (relation = 'after_query_time' AND "at" > 0 AND start + 30 < "at")) AS timed
  FROM p, v WHERE len(wanted) = 0 OR list_has_any(list_transform(tags, lambda x: lower(x)), wanted)
), c1 AS (SELECT * FROM pairs QUALIFY dated OR count(*) FILTER (dated) OVER (PARTITION BY qid) = 0
), c2 AS (SELECT * FROM c1 QUALIFY timed OR count(*) FILTER (timed) OVER (PARTITION BY qid) = 0
), means AS ({c.mean_sql("modal", "video, modality")}), vscore AS (SELECT qid, modality, video, {c.cos_sql("vec", "q_vec")} AS score FROM means JOIN c2 USING (video) JOIN qs USING (qid, modality)
), vlist AS ({c.top_sql("vscore", "qid, modality", "score DESC, video", 3)}), vfused AS (SELECT qid, video, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM vlist GROUP BY ALL
), chosen AS ({c.top_sql("vfused", "qid", "score DESC, video", 3, "video_rank")}), {WINDOWS}, inwin AS (SELECT w.video, w."window", s.* EXCLUDE (video) FROM windows AS w JOIN scenes AS s ON s.video = w.video AND s.ord >= w.first AND s.ord < w.first + w.n_scenes
), wvec AS ({c.mean_sql("(SELECT i.video, i." + chr(34) + "window" + chr(34) + ", m.modality, m.vec FROM inwin AS i JOIN modal AS m ON m.vec_id = i.vec_id)", 'video, "window", modality')}
), wmeta AS (SELECT video, "window", coalesce(any_value(v.start), 0) + min(inwin.start) AS s, coalesce(any_value(v.start), 0) + max(inwin."end") AS e, any_value(day) AS day, list_distinct(flatten(list(inwin.tags))) AS tags FROM inwin JOIN v USING (video) GROUP BY ALL
), wscore AS (
  SELECT qid, modality, video, "window", video_rank, {c.cos_sql("vec", "q_vec")} AS score FROM wvec JOIN wmeta USING (video, "window") JOIN chosen USING (video) JOIN p USING (qid) JOIN qs USING (qid, modality)
  WHERE win AND (len(days) = 0 OR list_contains(days, day)) AND (rng IS NULL OR len(list_filter(rng, lambda x: e >= x[1] AND s <= x[2])) > 0)
    AND (coalesce("at", 0) <= 0 OR day <> coalesce(date, '') OR ((relation <> 'before_query_time' OR s <= "at") AND (relation <> 'after_query_time' OR e >= "at"))) AND (len(wanted) = 0 OR list_has_any(tags, wanted))
), wlist AS ({c.top_sql("wscore", "qid, video, modality", 'score DESC, "window"', 4)}), wfused AS (SELECT qid, video, video_rank, "window", round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM wlist GROUP BY ALL
), wtop AS ({c.top_sql("wfused", "qid", 'score DESC, video_rank, "window"', 4)}
), inside AS (
  SELECT DISTINCT qid, video, video_rank, ord, 'windows' AS "by" FROM wtop JOIN inwin USING (video, "window") UNION ALL
  SELECT qid, video, video_rank, ord, 'videos' FROM chosen JOIN scenes USING (video) WHERE qid NOT IN (SELECT qid FROM wtop)
), allowed AS (SELECT i.* FROM inside AS i JOIN scenes AS s USING (video, ord) JOIN p USING (qid) WHERE len(wanted) = 0 OR list_has_any(s.tags, wanted)
), found AS ({c.scenes_sql("allowed", "video, ord").replace("sscore AS", "WITH sscore AS", 1)})
SELECT f.*, "by" FROM found AS f JOIN (SELECT DISTINCT qid, "by" FROM allowed) AS a USING (qid)""")
def planned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes under each query's plan: tags, days, times and relation decide which videos, windows and scenes count."""
    i, n = F.col("qid"), F.substring("video", 2, 9).cast("int")
    rows = tables.written(views.scenes(spark, sf_dir), "scenes")
    long = views.modal(rows)
    wanted = views.queries_of(long).drop("video", "ord")
    asked = wanted.select("qid").distinct().select("qid", F.concat(F.lit("Q"), F.element_at(F.array(*map(F.lit, c.ENDS)), (F.floor(i / 20) % 12 + 1).cast("int"))).alias("query_text"), F.when(i % 100 != 0, text("DAY", 1 + i % 7)).alias("query_date"), ((i * 977) % 86400).cast("double").alias("query_time_sec"), (i % 3 == 0).alias("need_audio"))
    raw = F.from_json(F.when(i % 60 == 0, F.lit('{"allowed_days": ["day 2", "DAY3"], "relation": "unrestricted", "time_of_day": "Morning", "use_windows": true}')), planner.RAW_PLAN.replace("\n", ""))
    plans = planner.plan(asked).join(asked, "qid").withColumn("plan", planner.merged_plan(F.col("plan"), planner.normalised_plan(raw)))
    tags = F.when(i % 40 == 0, F.array(F.lit("t1"), F.lit("T2"))).otherwise(F.array().cast(ARRAY))
    plans = tables.written(plans.select("qid", planner.constraints(F.col("plan"), F.col("query_text"), F.col("query_date"), F.col("query_time_sec")).alias("c"), planner.switches(F.col("plan"), ["a", "b"], windows=True).alias("s"), tags.alias("tags")), "plans")
    start = F.when(F.col("video") != "v9", n * 8640.0)
    about = lambda r: r.withColumn("day", text("DAY", 1 + n % 7))
    pooled = pooling.mean_vectors(long, ["video", "modality"]).groupBy("video").agg(F.collect_list(F.struct("modality", "vec")).alias("vecs"))  # a row a modality
    videos = about(pooled).withColumn("start", start).withColumn("tags", F.array(text("T", n % 3)))
    made = intervals.scene_windows(rows)
    places = made.withColumn("ord", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_scenes") - 1))).select("video", "window", "ord")
    members = places.join(rows.select("video", "ord", "start", "end", "tags"), ["video", "ord"])
    met = members.groupBy("video", "window").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))  # three scenes a window
    windows = retrieval.with_norm(pooling.mean_vectors(places.join(long, ["video", "ord"]), ["video", "window", "modality"])).join(met, ["video", "window"])
    windows = about(windows).withColumn("start", F.coalesce(start, F.lit(0.0)) + F.col("s")).withColumn("end", F.coalesce(start, F.lit(0.0)) + F.col("e")).drop("s", "e")
    found = search.planned_search(videos, windows, places, long.join(rows.select("video", "ord", "tags"), ["video", "ord"]).drop("vec_id"), wanted, plans, 3, 4, 5)
    return found.select("qid", "video", F.col("ord").cast("long"), "score", F.col("rank").cast("long"), "by")


@query(f"""WITH {ASOF}, t AS (SELECT person, day, "at" AS start, min(event_id) AS clip FROM clips GROUP BY ALL) SELECT event_id, CASE WHEN clip % 2 = 0 THEN 'seen ' || clip ELSE '' END AS context FROM found LEFT JOIN t USING (person, day, start)""")
def visual_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = views.clips(spark, sf_dir).groupBy("person", "day", F.col("at").alias("start")).agg(F.min("event_id").alias("clip"))
    known = clips.where("clip % 2 = 0").select("person", "day", "start", text("seen ", F.col("clip")).alias("text"))
    return c._asof(spark, sf_dir).join(known, ["person", "day", "start"], "left").select("event_id", F.coalesce("text", F.lit("")).alias("context"))


# ---- evaluation


@query(f"""WITH {ASOF}, used AS (SELECT person, day, "at" FROM clips QUALIFY row_number() OVER (PARTITION BY person, day ORDER BY value DESC, event_id) <= 3), p AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN []::VARCHAR[] ELSE ['DAY1', 'DAY' || (1 + event_id % 7)] END AS days, event_id % 3 AS k FROM found)
SELECT event_id, start IS NOT NULL AND EXISTS (SELECT 1 FROM used u WHERE u.person = p.person AND u.day = p.day AND u."at" = p.start) AS hit, CASE WHEN len(days) > 0 THEN list_contains(days, day) END AS day_hit,
CASE WHEN k > 0 THEN "at" BETWEEN 18000 * k AND 18000 * k + 20000 END AS time_hit FROM p""")
def qa_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    used = ranking.top_k(views.clips(spark, sf_dir), ["person", "day"], [F.desc("value"), F.asc("event_id")], 3).select("person", "day", F.col("at").alias("start")).distinct().withColumn("hit", F.lit(True))
    rows = c._asof(spark, sf_dir).join(used, ["person", "day", "start"], "left")
    days = F.when(i % 4 == 0, F.array().cast(ARRAY)).otherwise(F.array(F.lit("DAY1"), text("DAY", 1 + i % 7)))
    a = i % 3 * 18000.0
    ranges = F.when(i % 3 == 0, F.array().cast(planner.RANGES)).otherwise(F.array(F.struct(a.alias("s"), (a + 20000).alias("e"))))
    return rows.select("event_id", F.coalesce("hit", F.lit(False)).alias("hit"), metrics.day_hit(days, F.col("day")).alias("day_hit"), metrics.time_hit(ranges, F.col("at")).alias("time_hit"))


@query(f"""WITH {ASOF}, p AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN []::VARCHAR[] ELSE ['DAY1', 'DAY' || (1 + event_id % 7)] END AS days, event_id % 3 AS k FROM found
), h AS (SELECT day AS label, CASE WHEN len(days) > 0 THEN list_contains(days, day) END AS d, CASE WHEN k > 0 THEN "at" BETWEEN 18000 * k AND 18000 * k + 20000 END AS t FROM p)
SELECT coalesce(label, 'all') AS label, count(*) AS n, count(d) AS day_applied, count(*) FILTER (d) AS day_hits, count(t) AS time_applied, count(*) FILTER (t) AS time_hits,
  CASE WHEN count(d) = 0 THEN 'never' ELSE count(*) FILTER (d) || '/' || count(d) || ' of ' || count(*) END AS day_line FROM h GROUP BY ROLLUP (label)""")
def plan_accuracy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the day and time filters were applied and kept the truth, by day and over all."""
    i = F.col("event_id")
    days = F.when(i % 4 == 0, F.array().cast(ARRAY)).otherwise(F.array(F.lit("DAY1"), text("DAY", 1 + i % 7)))
    a = i % 3 * 18000.0
    ranges = F.when(i % 3 == 0, F.array().cast(planner.RANGES)).otherwise(F.array(F.struct(a.alias("s"), (a + 20000).alias("e"))))
    rows = c._asof(spark, sf_dir).select(F.col("day").alias("label"), metrics.day_hit(days, F.col("day")).alias("d"), metrics.time_hit(ranges, F.col("at")).alias("t"))
    return metrics.accuracy_log(rows, "label", "d", "t")


FLAT = f"""{SCENES}, res AS (SELECT vec_id // 40 * 20 AS qid, video, ord, count(*) OVER (PARTITION BY vec_id // 40, video) / 10 AS vs, CASE WHEN ord % 3 <> 0 THEN vec[1] END AS ss FROM scenes), flat AS (SELECT qid, video, ord AS scene, coalesce(ss, vs) AS score FROM res)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of forty scenes a query, whose ids grow with the table."""
    s = views.scenes(spark, sf_dir).select((F.floor(F.col("vec_id") / 40) * 20).alias("qid"), "video", F.struct(F.col("ord").alias("scene"), F.when(F.col("ord") % 3 != 0, F.col("vec")[0]).alias("score")).alias("s"))
    return s.groupBy("qid", "video").agg((F.count("*") / 10).alias("score"), F.collect_list("s").alias("scenes"))


@query(f"""WITH {FLAT} SELECT qid, video, scene, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, video, scene) AS rank FROM flat""")
def flat_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.flattened(_results(spark, sf_dir)).select("qid", "video", F.col("scene").cast("long"), F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(f"""WITH {FLAT}, q AS (SELECT vec_id AS qid, vec_id * 1.0 AS s, CASE WHEN vec_id % 40 = 0 THEN vec_id + 3.0 ELSE 100.0 END AS e FROM scenes WHERE vec_id % 20 = 0), n AS (SELECT qid, count(*) AS n FROM flat GROUP BY qid)
SELECT count(*) AS n, count(*) FILTER (coalesce(n.n, 0) = 0) AS n_empty, count(*) FILTER (s >= e) AS n_invalid, round(avg(coalesce(n.n, 0)), 6) AS mean_predictions FROM q LEFT JOIN n USING (qid)""")
def evaluation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    asked = table(spark, sf_dir, "embeddings").where(i % 20 == 0).select(i.alias("qid"), (i * 1.0).alias("start"), F.when(i % 40 == 0, i + 3.0).otherwise(100.0).alias("end"))
    return metrics.evaluation_stats(asked, metrics.flattened(_results(spark, sf_dir)))


def _iou_sql(a: str, b: str) -> str:
    return f"""CASE WHEN least("end", {b}) > greatest(start, {a}) THEN (least("end", {b}) - greatest(start, {a})) / (("end" - start) + ({b} - {a}) - (least("end", {b}) - greatest(start, {a}))) ELSE 0 END"""


@query(f"""WITH {SCENES} SELECT vec_id, round(greatest({_iou_sql("(start - 3)", "(start + 4)")}, {_iou_sql("0", "5")}, {_iou_sql("(start + 8)", "(start + 30)")}), 6) AS iou FROM scenes""")
def best_iou_of_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("start")
    given = [(s - 3, s + 4), (F.lit(0.0), F.lit(5.0)), (s + 8, s + 30)]
    truths = F.array(*(F.struct(a.alias("start"), b.alias("end")) for a, b in given))
    return views.scenes(spark, sf_dir).select("vec_id", F.round(metrics.best_iou(s, F.col("end"), truths), 6).alias("iou"))


@query(f"""WITH {c.PREDICTIONS.replace("rank <= 10", "rank <= 26")}, grid AS (SELECT k, tau::DOUBLE AS tau FROM (VALUES (1), (5), (10), (15), (20), (25), (7)) a(k), (VALUES (0.1), (0.3), (0.5), (0.7)) b(tau))
SELECT k, tau, round(avg((EXISTS (SELECT 1 FROM preds p WHERE p.qid = gt.qid AND p.rank <= k AND p.iou >= tau))::INT), 6) AS recall FROM gt, grid GROUP BY ALL""")
def evaluator_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of 26, the query itself among them, so there is something at each k."""
    return metrics.recall_table(*c._predictions(spark, sf_dir, 26), sorted({1, 5, 10, 15, 20, 25, 7}), [0.1, 0.3, 0.5, 0.7]).select("k", "tau", "recall")


@query(f"""WITH {SCENES}, g AS (SELECT video, ord AS scene, start, "end", vec[1] AS score, lag("end") OVER (PARTITION BY video ORDER BY start, ord) AS before FROM scenes
), i AS (SELECT *, sum(CASE WHEN start - before BETWEEN 0 AND 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY start, scene) AS island FROM g
), p AS (SELECT *, row_number() OVER (PARTITION BY video, island ORDER BY start, scene) - 1 AS place FROM i
), z AS (SELECT *, place // 3 AS part, count(*) OVER (PARTITION BY video, island, place // 3) AS size FROM p
), m AS (SELECT video, min(start) AS start, round(avg(score), 6) AS mean, round(sum(score), 6) AS total FROM z GROUP BY video, island, part, CASE WHEN size < 2 THEN place ELSE -1 END)
SELECT video, start, mean, total, row_number() OVER (PARTITION BY video ORDER BY mean DESC, start) AS rank FROM m""")
def merge_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir).select("video", F.col("ord").alias("scene"), "start", "end", F.col("vec")[0].alias("score"))
    mean, total = (intervals.merge_consecutive(s, ["video"], most=3, how=how).select("video", "start", F.round("score", 6).alias(name)) for how, name in (("avg", "mean"), ("sum", "total")))
    return ranking.top_k(mean.join(total, ["video", "start"]), ["video"], [F.desc("mean"), F.asc("start")]).select("video", "start", "mean", "total", F.col("rank").cast("long"))


@query("""WITH ch AS (SELECT DISTINCT doc_id FROM labels) SELECT count(*) AS total, count(ch.doc_id) AS replaced FROM documents d LEFT JOIN ch USING (doc_id)""")
def replaced_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.annotation_replace(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("replaced").alias("replaced"))
