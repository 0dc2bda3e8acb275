"""Queries of streams, and of sources and sinks over files that they write and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import SENTENCES_SQL, planner_sql, query, sentences
from .functions import texts, times, vectors
from .operators import layout, text_metrics
from .plans import planner
from .sources import annotations, clip_tree, nested, tables
from .sources.views import table
from .streaming import events, resume, sessions

# ---- streams

#: Gap of a session, and how far rows may come late.
GAP_S, LATE = 4 * 3600, "2 days"

_TIMED = """t AS (
  SELECT user_id, event_id AS scene, epoch_us(ts) AS s, epoch_us(ts) + 1000000 * (30 + event_id % 600) AS e, value AS score FROM events WHERE ts IS NOT NULL
)"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("ts IS NOT NULL").select("user_id", F.col("event_id").alias("scene"), F.col("ts").cast("timestamp").alias("start"), F.col("value").alias("score"))
    return rows.withColumn("end", F.timestamp_micros(F.unix_micros("start") + 1_000_000 * (30 + F.col("scene") % 600)))


@query(f"""WITH {_TIMED}, g AS (
  SELECT *, CASE WHEN s - lag(e) OVER w BETWEEN 0 AND {GAP_S * 1_000_000} THEN 0 ELSE 1 END AS split FROM t WINDOW w AS (PARTITION BY user_id ORDER BY s, scene)
), i AS (SELECT *, sum(split) OVER (PARTITION BY user_id ORDER BY s, scene) AS island FROM g
), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY s, scene) - 1 AS place FROM i
), c AS (SELECT *, place // 5 AS part, count(*) OVER (PARTITION BY user_id, island, place // 5) AS size FROM p)
SELECT user_id, min(s) AS start_us, arg_max(e, place) AS end_us, string_agg(scene::VARCHAR, '_' ORDER BY place) AS scenes, count(*) AS n, round(max(score), 6) AS score
FROM c GROUP BY user_id, island, part, CASE WHEN size < 2 THEN place ELSE -1 END""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream that comes in four parts, half of them half a day late, and is started again for each; a last row moves
    the watermark past all of them."""
    sessions.rocksdb(spark)
    place = tables.new_folder(spark, "sessions")
    rows = _timed(spark, sf_dir)
    seen = F.unix_seconds("start") + (F.col("scene") % 2) * 43_200
    low, high = rows.agg(F.min(seen), F.max(seen)).first()
    part = F.floor((seen - F.lit(low or 0)) * 4 / F.lit((high or 0) - (low or 0) + 1))
    last = rows.limit(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("scene"), F.timestamp_seconds(F.lit((high or 0) + 10**8)).alias("start"), F.lit(0.0).alias("score"), F.timestamp_seconds(F.lit((high or 0) + 10**8)).alias("end"))
    kind = "user_id long, start_us long, end_us long, scenes string, n long, score double"
    for arrived in [rows.where(part == n) for n in range(4)] + [last]:
        arrived.write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
        made = sessions.capped_sessions(stream, "user_id", GAP_S, late=LATE)
        run = made.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(kind).parquet(f"{place}/out").withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(coalesce(text, '') || '!') ELSE md5(coalesce(text, '')) END AS digest, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS stamp,
CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS made_in FROM documents WHERE doc_id IS NOT NULL""")
def resume_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come as a stream; then every seventh comes again, changed, with others that are unchanged and stay as they were made."""
    place = tables.new_folder(spark, "encoding")
    held = resume.VersionedTable(spark, f"{place}/table", "doc_id", "stamp", "doc_id long, stamp int, digest string, made_in int")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("stamp"))
    again = docs.where("doc_id % 7 = 0").select("doc_id", F.concat("text", F.lit("!")).alias("text"), F.lit(2).alias("stamp")).union(docs.where("doc_id % 7 = 1"))
    for number, arrived in enumerate((docs, again)):
        arrived.write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{place}/in")
        encode = lambda rows, number=number: rows.select("doc_id", "stamp", F.md5("text").alias("digest"), F.lit(number).alias("made_in"))
        resume.encode_stream(stream, held, encode, f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return held.read().select("doc_id", "digest", "stamp", "made_in")


# ---- sources and sinks: files that the query writes and reads back

_SAID = """said AS (
  SELECT 'v' || (conv_id % 40) AS video, 'c' || conv_id AS clip, conv_id, turn, coalesce(left(text, 30), '') AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations
), clips AS (SELECT DISTINCT video, clip, conv_id, dense_rank() OVER (PARTITION BY video ORDER BY conv_id) - 1 AS j FROM said)"""


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested annotations: a video of every fortieth, a clip each, a query a turn."""
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 40).alias("v"), "conv_id", "turn", F.coalesce(F.left("text", F.lit(30)), F.lit("")).alias("q"))
    empty = annotations.QUERY.replace("\n", "")
    query_ = F.struct(F.col("q").alias("query"), (F.col("turn") * 2).cast("double").alias("video_start_sec"), (F.col("turn") * 2 + 1).cast("double").alias("video_end_sec"))
    whole = F.from_json(F.to_json(query_), empty)
    clips = said.groupBy("v", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", whole.alias("e"))), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("t"))  # a conversation's turns
    clip = F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("clip_uid"), F.array(F.struct(F.transform("t", lambda x: x["e"]).alias("language_queries"))).alias("annotations"))
    videos = clips.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("conv_id", clip.alias("c"))), lambda a, b: (a["conv_id"] - b["conv_id"]).cast("int")).alias("cs"))
    video = F.struct(F.concat(F.lit("v"), F.col("v").cast("string")).alias("video_uid"), F.transform("cs", lambda x: x["c"]).alias("clips"))
    return videos.select(F.lit("1.0").alias("version"), F.lit("all").alias("split"), F.array(video).alias("videos"))


def _nlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotations, written as JSON and read with the reader's schema."""
    place = tables.new_folder(spark, "nlq")
    annotations.write_json(_annotated(spark, sf_dir), place)
    return spark.read.schema(annotations.NLQ.replace("\n", "")).json(place)


@query(f"""WITH {_SAID} SELECT video || '_' || j || '_' || i AS qid, video AS video_uid, clip AS clip_uid, q AS query_text, turn * 2.0::DOUBLE AS start_sec, turn * 2.0::DOUBLE + 1 AS end_sec, -1 AS start_frame
FROM said JOIN clips USING (video, clip, conv_id)""")
def nlq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.nlq_queries(_nlq(spark, sf_dir)).drop("end_frame")


@query(f"""WITH {_SAID}, ch AS (SELECT clip, q, arg_max('new ' || turn, turn) AS text FROM said WHERE turn % 3 = 0 GROUP BY clip, q
) SELECT video || '_' || j || '_' || i AS qid, coalesce(ch.text, said.q) AS query_text, CASE WHEN ch.text IS NULL THEN turn * 2.0::DOUBLE ELSE 0 END AS start_sec,
  count(*) OVER (PARTITION BY video) AS n_queries, count(ch.text) OVER (PARTITION BY video) AS n_replaced
FROM said JOIN clips USING (video, clip, conv_id) LEFT JOIN ch ON ch.clip = said.clip AND ch.q = said.q""")
def nested_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn's query gets a new entry inside its video's arrays; the last change of the same text of a clip wins."""
    said = table(spark, sf_dir, "conversations").where("turn % 3 = 0")
    new = F.struct(F.concat(F.lit("new "), F.col("turn").cast("string")).alias("query"), F.lit(0.0).alias("video_start_sec"), F.lit(1.0).alias("video_end_sec"))
    text_ = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    changes = said.select(text_("v", F.col("conv_id") % 40).alias("video_uid"), text_("c", F.col("conv_id")).alias("clip_uid"), F.coalesce(F.left("text", F.lit(30)), F.lit("")).alias("query"), F.col("turn").alias("seq"), F.from_json(F.to_json(new), annotations.QUERY.replace("\n", "")).alias("entry"))
    done = tables.written(nested.replaced(nested.videos_of(_nlq(spark, sf_dir)), changes, "entry"), "updated")
    counts = done.select(F.col("v.video_uid").alias("video_uid"), F.col("n_queries").cast("long"), F.col("n_replaced").cast("long"))
    rows = annotations.nlq_queries(nested.files_of(done.drop("n_queries", "n_replaced")))
    return rows.join(counts, "video_uid").select("qid", "query_text", "start_sec", "n_queries", "n_replaced")


@query("""SELECT 'A' || (user_id % 6 + 1) AS person, 'P' || (user_id % 6 + 1) AS who, 'DAY' || (1 + event_id % 7) AS day, sum(length(event_id::VARCHAR) + 1)::BIGINT AS size FROM events WHERE event_id % 7 IN (1, 3) AND user_id IS NOT NULL GROUP BY ALL""")
def clip_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders by person and day, listed by the data source; two days are asked for, and only their folders are read."""
    place = tables.new_folder(spark, "tree")
    u = (F.col("user_id") % 6 + 1).cast("string")
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_id IS NOT NULL")
    rows = e.select(F.concat(F.lit("A"), u, F.lit("_P"), u).alias("who"), F.concat(F.lit("DAY"), (1 + F.col("event_id") % 7).cast("string")).alias("day"), F.col("event_id").cast("string").alias("value"))
    rows.repartition("who", "day").write.partitionBy("who", "day").text(place)
    clip_tree.register(spark)
    source = spark.read.format("clip_tree").option("personPattern", r"who=(A\d+)_(.+)").option("dayPattern", r"day=(DAY\d+)").option("filePattern", r"\.txt$")
    listed = source.load(place).where(F.col("day").isin("DAY2", "DAY4"))
    return listed.groupBy("person", "who", "day").agg(F.sum("size").alias("size"))


@query("""SELECT 'v' || (vec_id % 9) AS video_name, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS total, 2 AS n_columns FROM embeddings WHERE vec_id % 9 < 4 GROUP BY 1""")
def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with key frames written by video (the frames are dropped) and read again for some videos; names lose their ending."""
    place = tables.new_folder(spark, "dataset")
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.concat(F.lit("v"), (F.col("vec_id") % 9).cast("string"), F.lit(".mp4")).alias("video_name"), F.col("embedding")[0].cast("double").alias("x"), F.lit("frame").alias("keyframes"))
    annotations.write_dataset(rows, place, ["video_name"])
    held = annotations.load(spark, "Dataset", place)
    some = held.where(F.col("video_name").isin("v0", "v1", "v2", "v3"))
    return some.groupBy("video_name").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total")).withColumn("n_columns", F.lit(len(held.columns)))


@query("""WITH c AS (SELECT doc_id, text, 'id' || (doc_id % 300) AS id, 'clip' || (doc_id % 200) AS video FROM documents WHERE coalesce(text, '') <> ''), k AS (
  SELECT id AS key, doc_id, text FROM c UNION ALL SELECT video, doc_id, text FROM c)
SELECT key, md5(arg_max(text, doc_id)) AS text_md5 FROM k GROUP BY key""")
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions written as JSON and read into the index by id, id without its language, and clip; later captions win."""
    place = tables.new_folder(spark, "captions")
    d = table(spark, sf_dir, "documents")
    turn = lambda who, said: F.struct(F.lit(who).alias("from"), said.alias("value"))
    i = F.col("doc_id")
    rows = d.select(F.concat(F.lit("id"), (i % 300).cast("string"), F.lit("_en")).alias("id"), F.concat(F.lit("x/clip"), (i % 200).cast("string"), F.lit(".mp4")).alias("video"), F.array(turn("human", F.lit("say")), turn("gpt", F.lit("")), turn("gpt", F.coalesce("text", F.lit("")))).alias("conversations"), i.alias("seq"))
    annotations.write_json(rows, place)
    read = spark.read.schema(annotations.CAPTIONS + ", seq long").json(place)
    return annotations.caption_index(read).where("key NOT LIKE '%\\\\_en'").select("key", F.md5("text").alias("text_md5"))


@query("""SELECT 'R@' || k || '_IoU=' || tau AS metric, round(avg((score >= tau)::INT), 6) AS value FROM (SELECT vec_id, abs(embedding[k])::DOUBLE AS score, k FROM embeddings, (VALUES (1), (5)) AS a(k)), (VALUES (0.1::DOUBLE), (0.3)) AS b(tau) GROUP BY k, tau""")
def metric_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of metrics written twice under the same name, and read from the second, whose name is its own."""
    place = tables.new_folder(spark, "metrics")
    e = table(spark, sf_dir, "embeddings")
    grid = [(k, t) for k in (1, 5) for t in (0.1, 0.3)]
    one = e.agg(*(F.round(F.avg((F.abs(F.col("embedding")[k - 1]).cast("double") >= t).cast("int")), 6).alias(f"R@{k}_IoU={t}") for k, t in grid))
    first, second = (annotations.write_table(one, place, "table") for _ in range(2))
    if first == second:
        raise RuntimeError("a table was written over")
    wide = spark.read.option("header", True).option("inferSchema", True).csv(second)
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns))))


@query("""SELECT conv_id, turn, role AS name, CASE WHEN turn % 2 = 0 THEN coalesce(left(text, 40), '') ELSE '' END AS answer, CASE WHEN turn % 2 = 0 THEN '' ELSE 'ValueError: said "no", twice' END AS error FROM conversations""")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and errors, with quotes, commas and line feeds, through a CSV with a header."""
    place = tables.new_folder(spark, "answers")
    even = F.col("turn") % 2 == 0
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("name"), F.when(even, F.coalesce(F.left("text", F.lit(40)), F.lit(""))).otherwise("").alias("answer"), F.when(even, "").otherwise('ValueError: said "no", twice').alias("error"))
    annotations.write_csv(rows, place)
    read = spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(place)
    return read.select("conv_id", "turn", "name", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("error", F.lit("")).alias("error"))


@query(f"""WITH {_SAID} SELECT DISTINCT video AS video_uid, 'scene_' || j AS scene_id, 0.0::DOUBLE AS start_time, 0.0::DOUBLE AS end_time, 0 AS start_frame FROM clips WHERE substr(video, 2)::INT % 2 = 0""")
def nlq_scene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each clip of the available videos; missing times are 0."""
    nlq = _nlq(spark, sf_dir)
    there = annotations.video_ids(nlq).where(F.substring("video_uid", 2, 9).cast("int") % 2 == 0)
    return annotations.nlq_scenes(nlq, there).drop("end_frame")


@query(f"""WITH {_SAID} SELECT video || '_' || j || '_' || i AS qid, q AS query_text, turn * 2.0::DOUBLE AS start_sec FROM said JOIN clips USING (video, clip, conv_id) WHERE trim(q) <> '' AND turn % 4 <> 3""")
def nlq_strict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a text and times; every fourth turn's end is taken out first, by an update of its entry."""
    nlq = _nlq(spark, sf_dir)
    turn = lambda q: (q["video_start_sec"] / 2).cast("int")
    without = nested.each_query(F.col("v"), lambda c, q: F.when(turn(q) % 4 == 3, q.withField("video_end_sec", F.lit(None).cast("double"))).otherwise(q))
    cut = nested.files_of(nested.videos_of(nlq).withColumn("v", without))
    return annotations.nlq_queries(cut, strict=True).select("qid", "query_text", "start_sec")


@query("""WITH f AS (SELECT DISTINCT user_id % 6 + 1 AS w, 1 + event_id % 7 AS d FROM events WHERE user_id IS NOT NULL)
SELECT 'DAY' || d || '_A' || w || '_P_' || w || '_1' || d || '30000' || w AS name, 'DAY' || d AS day, 'A' || w AS person, 'P_' || w AS who, round((10 + d) * 3600 + 1800 + w / 100.0::DOUBLE, 6) AS start FROM f""")
def clip_files_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips under their real names in folders by person and day, found by a scan of all files below the root."""
    place = tables.new_folder(spark, "clips")
    w, d = (F.col("user_id") % 6 + 1).cast("string"), (1 + F.col("event_id") % 7).cast("string")
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_id IS NOT NULL")
    rows = e.select(F.concat(F.lit("A"), w, F.lit("_P_"), w).alias("who"), F.concat(F.lit("DAY"), d).alias("day"), F.col("event_id").cast("string").alias("value"))
    rows.repartition("who", "day").write.partitionBy("who", "day").text(f"{place}/raw")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(place).getFileSystem(spark._jsc.hadoopConfiguration())
    for person in range(1, 7):  # 42 folders, whatever the table's size
        for day in range(1, 8):
            who, folder = f"A{person}_P_{person}", hadoop(f"{place}/raw/who=A{person}_P_{person}/day=DAY{day}")
            parts = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
            for part in [x for x in parts if x.getName().startswith("part-")]:
                files.mkdirs(hadoop(f"{place}/tree/{who}/DAY{day}"))
                files.rename(part, hadoop(f"{place}/tree/{who}/DAY{day}/DAY{day}_{who}_1{day}30000{person}.mp4"))
    return annotations.clip_files(spark, f"{place}/tree").select("name", "day", "person", "who", F.round("start", 6).alias("start"))


@query("""WITH h AS (SELECT 'P' || (event_id % 4) AS person, event_type AS setting, k, count(*) FILTER (event_id % 30 < k) AS hits, count(*) AS total FROM events, (VALUES (1), (5), (10)) AS v(k) GROUP BY ALL)
SELECT person, setting, k, hits, total, round(hits / total::DOUBLE, 6) AS recall FROM h""")
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of recalls with maps inside, one object a person, written as JSON and read back flat."""
    place = tables.new_folder(spark, "summary")
    ks = (1, 5, 10)
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string")).alias("person"), F.col("event_type").alias("setting"), (F.col("event_id") % 30).alias("place"))
    one = lambda k: F.struct(F.count_if(F.col("place") < k).alias("hits"), F.count("*").alias("total"), F.round(F.count_if(F.col("place") < k) / F.count("*"), 6).alias("recall"))
    each = e.groupBy("person", "setting").agg(F.create_map(*(x for k in ks for x in (F.lit(str(k)), one(k)))).alias("recall_at_k"))
    people = each.groupBy("person").agg(F.collect_list(F.struct("setting", "recall_at_k")).alias("configurations"))  # a row a setting
    annotations.write_json(people.withColumn("topk_list", F.array(*map(F.lit, ks))), place)
    read = spark.read.schema("person string, topk_list array<int>, configurations array<struct<setting:string,recall_at_k:map<string,struct<hits:bigint,total:bigint,recall:double>>>>").json(place)
    flat = read.select("person", F.inline("configurations")).select("person", "setting", F.explode("recall_at_k").alias("k", "r"))
    return flat.select("person", "setting", F.col("k").cast("int").alias("k"), "r.hits", "r.total", "r.recall")


@query("""SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k, event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'x ' || event_id END AS note, event_id % 5 = 0 AS flag FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of replies with defaults for those that lack, in strings without the blanks around them."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    held = F.concat(F.lit('{"name": "  '), F.col("event_type"), F.lit(' ", "note": '), F.when(i % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"\\tx '), i.cast("string"), F.lit(' \\n"'))), F.when(i % 5 == 0, F.lit(', "flag": true')).otherwise(""), F.lit("}"))
    read = e.select("event_id", F.from_json("props", "k long").alias("p"), texts.parsed(held, "name string, note string, flag boolean", {"note": "none", "flag": False}).alias("r"))
    return read.select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), "r.name", "r.note", "r.flag")


# ---- texts against references

_TOKENS = """t AS (
  SELECT conv_id * 1000 + turn AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations
), w AS (SELECT id, {a} AS a, {b} AS b FROM t WHERE after IS NOT NULL)"""
_WORDS_SQL = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_BLANKS_SQL = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"


def _tokens_sql(form: str) -> str:
    return _TOKENS.format(a=form.format("text"), b=form.format("after"))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next of its conversation."""
    t = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("candidate"), after.alias("reference")).where("reference IS NOT NULL")


@query(f"""WITH {_tokens_sql(_WORDS_SQL)}, l AS (
  SELECT id, len(a) AS x, len(b) AS y, list_last(list_reduce(a, lambda row, c: list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN b[j] = c THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT]),
         list_transform(range(0, len(b) + 1), lambda z: 0::BIGINT))) AS n FROM w
) SELECT id, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * n / (x + y) END, 6) AS rouge_l FROM l""")
def rouge_l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common subsequence bit by bit here, cell by cell in the SQL."""
    return text_metrics.rouge_l(_turn_pairs(spark, sf_dir)).select("id", F.round("rouge_l", 6).alias("rouge_l"))


@query(f"""WITH {_tokens_sql(_BLANKS_SQL)}, g AS (
  SELECT id, k, 0 AS side, array_to_string(a[i:i + k - 1], ' ') AS gram FROM w, range(1, 5) AS r(k), unnest(range(1, len(a) - k + 2)) AS s(i)
  UNION ALL SELECT id, k, 1, array_to_string(b[i:i + k - 1], ' ') FROM w, range(1, 5) AS r(k), unnest(range(1, len(b) - k + 2)) AS s(i)
), c AS (SELECT id, k, gram, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS n FROM g GROUP BY ALL
), h AS (SELECT w.id, r.k, len(a) AS x, len(b) AS y, coalesce((SELECT sum(n) FROM c WHERE c.id = w.id AND c.k = r.k), 0) AS n FROM w, range(1, 5) AS r(k)
), m AS (SELECT *, count(*) FILTER (n = 0) OVER (PARTITION BY id ORDER BY k) AS missed FROM h
), p AS (SELECT id, x, y, min(CASE WHEN k = 1 THEN n END) AS first, sum(ln(CASE WHEN n > 0 THEN n::DOUBLE WHEN x > 1 THEN ln(x) / (pow(2, missed) * 5) ELSE 1e-9 END / greatest(x - k + 1, 1))) / 4 AS logs FROM m WHERE x > 0 GROUP BY ALL)
SELECT w.id, round(CASE WHEN len(a) = 0 OR len(b) = 0 OR first = 0 THEN 0 ELSE exp(logs) * CASE WHEN x < y THEN exp(1 - y::DOUBLE / x) ELSE 1 END END, 6) AS bleu FROM w LEFT JOIN p USING (id)""")
def bleu_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.bleu(_turn_pairs(spark, sf_dir)).select("id", F.round("bleu", 6).alias("bleu"))


@query(f"""WITH {_tokens_sql(_BLANKS_SQL.replace("coalesce({0}, '')", "lower(coalesce({0}, ''))"))}, a AS (SELECT id, unnest(a) AS word, unnest(range(len(a))) AS place FROM w), b AS (SELECT id, unnest(b) AS word, unnest(range(len(b))) AS place FROM w
), m AS (SELECT x.id, x.place AS i, y.place AS j FROM (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY place DESC) AS n FROM a) AS x JOIN (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY place DESC) AS n FROM b) AS y USING (id, word, n)
), c AS (SELECT id, count(*) AS matches, count(*) FILTER (i IS DISTINCT FROM pi + 1 OR j IS DISTINCT FROM pj + 1) AS chunks FROM (SELECT *, lag(i) OVER (PARTITION BY id ORDER BY i) AS pi, lag(j) OVER (PARTITION BY id ORDER BY i) AS pj FROM m) GROUP BY id
), s AS (SELECT w.id, coalesce(matches, 0) AS matches, coalesce(chunks, 0) AS chunks, matches / len(a)::DOUBLE AS p, matches / len(b)::DOUBLE AS r FROM w LEFT JOIN c USING (id))
SELECT id, matches, chunks, round(CASE WHEN matches = 0 THEN 0 ELSE p * r / (0.9::DOUBLE * p + 0.1::DOUBLE * r) * (1 - 0.5 * pow(chunks::DOUBLE / matches, 3)) END, 6) AS meteor FROM s""")
def meteor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the stage of stems, which SQL can't express."""
    found = text_metrics.meteor(_turn_pairs(spark, sf_dir), stemmed=False)
    return found.select("id", "matches", F.col("chunks").cast("long").alias("chunks"), F.round("meteor", 6).alias("meteor"))


@query()
def meteor_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.meteor(_turn_pairs(spark, sf_dir)).select("id", "matches", "chunks", F.round("meteor", 6).alias("meteor"))


@query()
def rouge_l_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.rouge_l_stemmed(_turn_pairs(spark, sf_dir)).select("id", F.round("rouge_l", 6).alias("rouge_l"))


# ---- neighbours


@query()
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of each vector."""
    found = layout.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return found.select(F.col("u").alias("vec_id"), F.col("v").alias("neighbour"), F.round("score", 6).alias("score"), F.col("rank").cast("long"))


# ---- functions and streams over the tables


@query("""WITH n AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'short_name' WHEN event_id % 6 = 1 THEN 'Day' || (1 + event_id % 7) || '_a2_OLD_OAK_' || event_type || '_1' || lpad((event_id % 1000)::VARCHAR, 7, '0')
  ELSE 'DAY' || (1 + event_id % 7) || '_A' || (user_id % 6) || '_N' || user_id || '_' || lpad((event_id % 1000)::VARCHAR, 8, '0') END AS name FROM events), p AS (SELECT event_id, name, string_split(name, '_') AS p FROM n)
SELECT event_id, 'x/y/' || name || '.v1.mp4' AS path, name || '.v1' AS stem, CASE WHEN len(p) >= 4 THEN p[1] END AS day, CASE WHEN len(p) >= 4 THEN p[2] END AS person, CASE WHEN len(p) >= 4 THEN array_to_string(p[3:len(p) - 1], '_') END AS who,
  CASE WHEN len(p) >= 4 THEN p[len(p)] END AS time FROM p""")
def clip_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, day = F.col("event_id"), (1 + F.col("event_id") % 7).cast("string")
    low = (i % 1000).cast("string")
    odd = F.concat(F.lit("Day"), day, F.lit("_a2_OLD_OAK_"), "event_type", F.lit("_1"), F.lpad(low, 7, "0"))
    usual = F.concat(F.lit("DAY"), day, F.lit("_A"), (F.col("user_id") % 6).cast("string"), F.lit("_N"), F.col("user_id").cast("string"), F.lit("_"), F.lpad(low, 8, "0"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 6 == 0, "short_name").when(i % 6 == 1, odd).otherwise(usual).alias("name"))
    rows = rows.withColumn("path", F.concat(F.lit("x/y/"), "name", F.lit(".v1.mp4"))).withColumn("p", times.clip_parts(F.col("name")))
    return rows.select("event_id", "path", times.stem(F.col("path")).alias("stem"), "p.day", "p.person", "p.who", "p.time")


@query("""WITH s AS (SELECT vec_id, vec_id % 90 + 3 AS size, vec_id % 7 + 1 AS n, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(list_sum(v[1:20]), 6) AS cut, round(list_sum(v), 6) AS padded, 80 AS n_padded, array_to_string(list_transform(range(8), lambda k: floor(k * (size - 1) / 7.0)::INT), ',') AS eight, '0' AS one, list_count(list_distinct(list_transform(range(8), lambda k: floor(k * (size - 1) / 7.0)::INT))) AS n_different FROM s""")
def padded_and_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut and padded to a size, and frames sampled evenly, eight at most."""
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 90 + 3).alias("size"))
    eight = vectors.even_indices(F.lit(0), F.col("size") - 1, 8)
    wide = vectors.pad_or_cut(F.col("v"), 80)
    return rows.select("vec_id", total(vectors.pad_or_cut(F.col("v"), 20)).alias("cut"), total(wide).alias("padded"), F.size(wide).alias("n_padded"), F.array_join(eight.cast("array<string>"), ",").alias("eight"), F.array_join(vectors.even_indices(F.lit(0), F.lit(5), 1).cast("array<string>"), ",").alias("one"), F.size(F.array_distinct(eight)).cast("long").alias("n_different"))


@query("""WITH r AS (SELECT conv_id, turn, coalesce(replace(text, chr(10), ' '), '') AS t FROM conversations), m AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'user: ask' || chr(10) || 'ASSISTANT: ' || t || ' ' WHEN 1 THEN t || chr(10) || '-----' || chr(10) || 'tail' ELSE t END AS reply FROM r)
SELECT conv_id, turn, md5(trim(t)) AS answer_md5, array_to_string(list_filter(['The', 'and', 'zebra'], lambda x: contains(lower(reply), lower(x))), ',') AS tags FROM m""")
def reply_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers behind an echo or before a dashed tail, and the tags of a vocabulary that a reply names."""
    t = F.coalesce(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit(""))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("user: ask\nASSISTANT: "), t, F.lit(" "))).when(F.col("turn") % 3 == 1, F.concat(t, F.lit("\n-----\ntail"))).otherwise(t)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return rows.select("conv_id", "turn", F.md5(texts.answer_part(F.col("reply"))).alias("answer_md5"), F.array_join(texts.tags_in_reply(F.col("reply"), ["The", "and", "zebra"]), ",").alias("tags"))


_ANY = " OR ".join(f"contains(t, '{p}')" for p in planner.RETRIEVER_ANY_DAY)


@query(f"""WITH plans AS ({planner_sql()}), src AS ({SENTENCES_SQL}), x AS (SELECT qid, t, d, regexp_extract(d, '(\\d+)', 1)::INT AS n, list_transform(list_distinct(regexp_extract_all(t, '\\bday\\s*([1-7])\\b', 1)), lambda z: 'DAY' || z) AS explicit FROM src)
SELECT qid, array_to_string(list_sort(CASE WHEN len(explicit) > 0 THEN explicit WHEN contains(t, 'yesterday') AND n > 1 THEN ['DAY' || (n - 1)] WHEN contains(t, 'tomorrow') AND n < 7 THEN ['DAY' || (n + 1)] WHEN {_ANY} THEN NULL WHEN d IS NOT NULL THEN [d] END), ',') AS inferred,
  array_to_string(list_filter(['rewrite_query', CASE WHEN days <> '' THEN 'day_filter' END, CASE WHEN ranges <> '' THEN 'time_range_filter' END, CASE WHEN relation IN ('before_query_time', 'after_query_time') THEN relation || '_filter' END, 'video_retrieval', 'window_retrieval', 'scene_retrieval',
    CASE WHEN ranges <> '' OR relation <> 'unrestricted' THEN 'temporal_rerank' END], lambda z: z IS NOT NULL), '>') AS workflow FROM plans JOIN x USING (qid)""")
def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each sentence's plan, and the days that the retriever would infer without one."""
    asked = sentences(spark, sf_dir)
    steps = planner.plan(asked, use_windows=True, rewrite_query=True).select("qid", F.array_join("plan.workflow", ">").alias("workflow"))
    days = planner.retriever_days(F.lower("query_text"), F.col("query_date"))
    return asked.select("qid", F.array_join(F.array_sort(days), ",").alias("inferred")).join(steps, "qid")


@query(f"""WITH {_TIMED}, p AS (SELECT user_id, s, (event_id % 10 = 3)::INT AS later FROM events JOIN (SELECT scene AS event_id, s FROM t) USING (event_id)
), m AS (SELECT max(s) - 86400000000 AS mark FROM p WHERE later = 0)
SELECT s // 3600000000 * 3600000000 AS start_us, user_id, count(*) AS n FROM p, m WHERE later = 0 OR s // 3600000000 * 3600000000 + 3600000000 > mark GROUP BY ALL""")
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of events on a stream; a tenth of the events comes behind the others, and counts only where the watermark lets it."""
    place = tables.new_folder(spark, "segments")
    rows = table(spark, sf_dir, "events").where("ts IS NOT NULL").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    late = F.col("event_id") % 10 == 3
    last = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts"), F.lit(0.0).alias("value"))
    for arrived in (rows.where(~late), rows.where(late), last):
        arrived.write.mode("append").parquet(f"{place}/in")
        seen = events.segments(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), "1 hour", "1 day")
        seen.select(F.unix_micros("start").alias("start_us"), "user_id", "n").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start_us long, user_id long, n long").parquet(f"{place}/out")
